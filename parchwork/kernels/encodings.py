"""Glyph names and single-byte encodings.

Glyph names are composed by rule from Unicode character names, and encodings
taken from Python's codecs; only what no rule gives is listed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

# Names of marks in glyph names.
MARKS = {
    "GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "MACRON": "macron", "BREVE": "breve",
    "DOT ABOVE": "dotaccent", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "DOUBLE ACUTE": "hungarumlaut",
    "OGONEK": "ogonek", "CARON": "caron", "DOT BELOW": "dotbelow", "HOOK ABOVE": "hookabove", "COMMA BELOW": "commaaccent", "STROKE": "slash",
    "HORN": "horn", "LINE BELOW": "linebelow", "CIRCUMFLEX BELOW": "circumflexbelow", "TILDE BELOW": "tildebelow", "RING BELOW": "ringbelow",
    "BREVE BELOW": "brevebelow", "DIAERESIS BELOW": "dieresisbelow", "DOUBLE GRAVE": "dblgrave", "INVERTED BREVE": "invertedbreve", "HOOK": "hook",
    "TOPBAR": "topbar", "TONOS": "tonos", "DIALYTIKA": "dieresis", "DIALYTIKA AND TONOS": "dieresistonos",
}
# Glyph names that no rule gives.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨",
    "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°",
    "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
    "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾",
    "questiondown": "¿", "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "multiply": "×", "divide": "÷", "Thorn": "Þ", "thorn": "þ",
    "germandbls": "ß", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ", "dotlessi": "ı", "florin": "ƒ",
    "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝",
    "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”",
    "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "partialdiff": "∂", "Delta": "∆", "product": "∏", "summation": "∑",
    "minus": "−", "radical": "√", "infinity": "∞", "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤",
    "greaterequal": "≥", "lozenge": "◊", "Omega": "Ω", "pi": "π", "apple": "", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ",
    "nbspace": " ", "sfthyphen": "­", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓",
}
# The upper half of the standard encoding, from 0xA1 on.
STANDARD_UPPER = {
    0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl",
    0xB1: "endash dagger daggerdbl periodcentered",
    0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand",
    0xBF: "questiondown",
    0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis",
    0xCA: "ring cedilla",
    0xCD: "hungarumlaut ogonek caron emdash",
    0xE1: "AE",
    0xE3: "ordfeminine",
    0xE8: "Lslash Oslash OE ordmasculine",
    0xF1: "ae",
    0xF5: "dotlessi",
    0xF8: "lslash oslash oe germandbls",
}
# Where the document encoding differs from Latin-1.
PDFDOC_OWN = {
    0x18: "breve caron circumflex dotaccent hungarumlaut ogonek ring tilde",
    0x80: "bullet dagger daggerdbl ellipsis emdash endash florin fraction guilsinglleft guilsinglright minus perthousand quotedblbase quotedblleft quotedblright quoteleft quoteright quotesinglbase trademark fi fl Lslash OE Scaron Ydieresis Zcaron dotlessi lslash oe scaron zcaron",
    0xA0: "Euro",
}


# Names of mathematical and symbol glyphs, with their characters.
SYMBOLS = dict(
    pair.rsplit("=", 1)
    for pair in (
        "universal=∀ existential=∃ suchthat=∋ asteriskmath=∗ congruent=≅ therefore=∴ perpendicular=⊥ similar=∼ minute=′ second=″ aleph=ℵ Ifraktur=ℑ "
        "Rfraktur=ℜ weierstrass=℘ circlemultiply=⊗ circleplus=⊕ emptyset=∅ intersection=∩ union=∪ propersuperset=⊃ reflexsuperset=⊇ notsubset=⊄ "
        "propersubset=⊂ reflexsubset=⊆ element=∈ notelement=∉ angle=∠ gradient=∇ dotmath=⋅ logicaland=∧ logicalor=∨ arrowboth=↔ arrowupdn=↕ arrowdblboth=⇔ "
        "arrowdblleft=⇐ arrowdblup=⇑ arrowdblright=⇒ arrowdbldown=⇓ carriagereturn=↵ angleleft=〈 angleright=〉 integraltop=⌠ integralbt=⌡ equivalence=≡ "
        "proportional=∝ club=♣ diamond=♦ heart=♥ spade=♠ theta1=ϑ Upsilon1=ϒ phi1=ϕ omega1=ϖ sigma1=ς orthogonal=∟ house=⌂ revlogicalnot=⌐ filledbox=■ "
        "filledrect=▬ H18533=■ H22073=□ H18543=▪ H18551=▫ triagup=▲ triagrt=► triagdn=▼ triaglf=◄ circle=○ invbullet=◘ invcircle=◙ smileface=☺ "
        "invsmileface=☻ sun=☼ female=♀ male=♂ musicalnote=♪ musicalnotedbl=♫ upblock=▀ dnblock=▄ block=█ lfblock=▌ rtblock=▐ ltshade=░ shade=▒ dkshade=▓ "
        "exclamdbl=‼ underscoredbl=‗ figuredash=‒ horizontalbar=― quotereversed=‛ onedotenleader=․ twodotenleader=‥ colonmonetary=₡ franc=₣ lira=₤ peseta=₧ "
        "dong=₫ estimated=℮ oneeighth=⅛ threeeighths=⅜ fiveeighths=⅝ seveneighths=⅞ onethird=⅓ twothirds=⅔ kgreenlandic=ĸ longs=ſ Eng=Ŋ eng=ŋ "
        "IJ=Ĳ ij=ĳ Ldot=Ŀ ldot=ŀ napostrophe=ŉ Tbar=Ŧ tbar=ŧ Hbar=Ħ hbar=ħ Dcroat=Đ dcroat=đ Idotaccent=İ anoteleia=· tonos=΄ dieresistonos=΅ "
        "nsuperior=ⁿ middot=· overline=‾ prime=′ product=∏ mu1=µ Ohm=Ω"
    ).split()
)
# Letters of the private use area, each with its code.
PRIVATE = {
    "zerooldstyle": 0xF730, "copyrightserif": 0xF6D9, "registerserif": 0xF6DA, "trademarkserif": 0xF6DB, "copyrightsans": 0xF8E9, "registersans": 0xF8E8,
    "trademarksans": 0xF8EA, "centinferior": 0xF6DF, "centsuperior": 0xF6E0, "commainferior": 0xF6E1, "commasuperior": 0xF6E2, "dollarinferior": 0xF6E3,
    "dollarsuperior": 0xF6E4, "hypheninferior": 0xF6E5, "hyphensuperior": 0xF6E6, "periodinferior": 0xF6E7, "periodsuperior": 0xF6E8, "asuperior": 0xF6E9,
    "bsuperior": 0xF6EA, "dsuperior": 0xF6EB, "esuperior": 0xF6EC, "isuperior": 0xF6ED, "lsuperior": 0xF6EE, "msuperior": 0xF6EF, "osuperior": 0xF6F0,
    "rsuperior": 0xF6F1, "ssuperior": 0xF6F2, "tsuperior": 0xF6F3, "exclamsmall": 0xF721, "dollaroldstyle": 0xF724, "ampersandsmall": 0xF726,
    "questionsmall": 0xF73F, "Gravesmall": 0xF760, "exclamdownsmall": 0xF7A1, "centoldstyle": 0xF7A2, "Dieresissmall": 0xF7A8, "Macronsmall": 0xF7AF,
    "Acutesmall": 0xF7B4, "Cedillasmall": 0xF7B8, "questiondownsmall": 0xF7BF,
}
# Numbered names: the first number, and the codes that follow one another from there.
NUMBERED = {
    10017: "0410-0415 0401 0416-042F 0490 0402-040C 040E", 10065: "0430-0435 0451 0436-044F 0491 0452-045C 045E", 10145: "040F 0462 0472 0474",
    10193: "045F 0463 0473 0475", 10846: "04D9", 57388: "060C", 57392: "0660-0669", 57403: "061B", 57407: "061F", 57409: "0621-063A", 57440: "0640-0646",
    57448: "0648-0652", 57470: "0647", 57505: "06A4 067E 0686 0698 06AF", 57511: "0679 0688 0691 06BA", 57519: "06D2", 57534: "06D5", 57636: "20AA", 57645: "05BE",
    57658: "05C3", 57664: "05D0-05EA", 57793: "05B4-05B6 05BB 05B8 05B7 05B0 05B2 05B1 05B3 05C2 05C1", 57806: "05B9 05BC", 57839: "05BD", 57841: "05BF 05C0",
    61248: "2105", 61289: "2113", 61352: "2116", 61573: "202C-202E", 61664: "200C", 57381: "066A", 63167: "066D",
}
#: Rules from a character's Unicode name to its glyph names: a pattern, and names of its groups in small letters without blanks.
RULES = (
    (r"(?:HIRAGANA|KATAKANA) LETTER (SMALL )?(\w+)", "{1}{0}{s}"),
    (r"HALFWIDTH KATAKANA LETTER (SMALL )?(\w+)", "{1}{0}katakanahalfwidth"),
    (r"BOPOMOFO LETTER (\w+)", "{0}bopomofo"),
    (r"HANGUL LETTER ([\w-]+)", "{0}korean"),
    (r"CIRCLED HANGUL ([\w ]+)", "{0}circlekorean"),
    (r"PARENTHESIZED HANGUL ([\w ]+)", "{0}parenkorean"),
    (r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI) (?:LETTER|SIGN) VOCALIC (\w+)", "{0}vocalic{s}"),
    (r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI) VOWEL SIGN VOCALIC (\w+)", "{0}vocalicvowelsign{s}"),
    (r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI) VOWEL SIGN (\w+)", "{0}vowelsign{s}"),
    (r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI) (?:LETTER|SIGN|DIGIT) (\w+)", "{0}{s}"),
    (r"THAI (?:CHARACTER|DIGIT) ([\w ]+)", "{0}thai"),
    (r"EXTENDED ARABIC-INDIC DIGIT (\w+)", "{0}persian"),
    (r"ARABIC-INDIC DIGIT (\w+)", "{0}arabic {0}hackarabic"),
    (r"ARABIC LETTER ([\w ]+?)(?: WITH ([\w ]+?))?(?: (INITIAL|MEDIAL|FINAL) FORM)?(?: ISOLATED FORM)?", "{0}{1}{2}arabic"),
    (r"ARABIC (\w+)", "{0}arabic"),
    (r"HEBREW (?:LETTER|POINT|PUNCTUATION|ACCENT) ([\w ]+?)(?: WITH ([\w ]+))?", "{0}{1} {0}{1}hebrew"),
    (r"CIRCLED LATIN SMALL LETTER (\w)", "{0}circle"),
    (r"(?:CIRCLED (?:DIGIT|NUMBER)) (\w+)", "{0}circle"),
    (r"(?:NEGATIVE CIRCLED|DINGBAT NEGATIVE CIRCLED) (?:DIGIT|NUMBER) (\w+)", "{0}circleinversesansserif"),
    (r"PARENTHESIZED (?:LATIN SMALL LETTER|DIGIT|NUMBER) (\w+)", "{0}paren"),
    (r"(?:DIGIT|NUMBER) (\w+) FULL STOP", "{0}period"),
    (r"SUPERSCRIPT (\w+)", "{0}superior"),
    (r"SUBSCRIPT (\w+)", "{0}inferior"),
    (r"(SMALL )?ROMAN NUMERAL (\w+)", "{1}roman"),
)
#: Blocks that the rules are applied to.
BLOCKS = ((0x591, 0x5F5), (0x600, 0x6FF), (0x901, 0xAFF), (0xE01, 0xE5C), (0x2070, 0x2090), (0x2160, 0x2180), (0x2460, 0x2501), (0x2776, 0x2794), (0x3041, 0x3130), (0x3131, 0x3190), (0x3200, 0x3280), (0xFB1D, 0xFB50), (0xFE70, 0xFEFD), (0xFF61, 0xFFA0))


def _by_rule() -> dict[str, str]:
    found: dict[str, str] = {}
    for begin, end in BLOCKS:
        for code in range(begin, end):
            name = unicodedata.name(chr(code), "")
            script = {"DEVANAGARI": "deva"}.get(name.partition(" ")[0], name.partition(" ")[0].lower())
            for pattern, made in RULES:
                if m := re.fullmatch(pattern, name):
                    groups = [(g or "").replace(" ", "").replace("-", "").lower() for g in m.groups()]
                    for glyph in made.format(*groups, s=script).split():
                        if "roman" in made and not m[1]:
                            glyph = glyph.capitalize()
                        found.setdefault(glyph, chr(code))
                    break
    for i in range(26):
        found[f"{chr(65 + i)}circle"], found[f"{chr(65 + i)}small"] = chr(0x24B6 + i), chr(0xF761 + i)
    for code in range(0x21, 0x7F):
        found[f"{_plain()[chr(code)]}monospace"] = chr(code + 0xFEE0)
    for i, digit in enumerate(DIGITS):
        found[f"{digit}oldstyle"] = chr(0xF730 + i)
    for first, codes in NUMBERED.items():
        number = first
        for run in codes.split():
            low, _, high = run.partition("-")
            for code in range(int(low, 16), int(high or low, 16) + 1):
                found[f"afii{number}"] = chr(code)
                number += 1
    return found


# Names of the digits.
DIGITS = "zero one two three four five six seven eight nine".split()


@cache
def _plain() -> dict[str, str]:
    """Characters of ASCII to their names."""
    return {c: n for n, c in NAMED.items() if len(c) == 1 and ord(c) < 0x7F} | {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"} | dict(zip("0123456789", DIGITS, strict=True))


@cache
def glyph_texts() -> dict[str, str]:
    """Glyph name to text."""
    found = {f"{c}": c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    found |= dict(zip(DIGITS, "0123456789", strict=True))
    for code in [*range(0xC0, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        name = unicodedata.name(char, "")
        if m := re.fullmatch(r"(LATIN|GREEK|ARMENIAN) (CAPITAL|SMALL) LETTER (\w+)(?: WITH ([\w ]+))?", name):
            script, case, letter, mark = m.groups()
            marks = [mark] if mark in MARKS else (mark or "").split(" AND ") if mark else []
            if any(x not in MARKS for x in marks) or (script == "LATIN" and len(letter) > 1):
                continue
            base = letter.capitalize() if case == "CAPITAL" else letter.lower()
            found.setdefault(base + "".join(MARKS[x] for x in marks) + ("armenian" if script == "ARMENIAN" else ""), char)
        elif m := re.fullmatch(r"CYRILLIC (CAPITAL|SMALL) LETTER (SHORT )?(\w+)(?: WITH (\w+))?", name):
            base = m[3].capitalize() if m[1] == "CAPITAL" else m[3].lower()
            found.setdefault(base + ("short" if m[2] else "") + MARKS.get(m[4], (m[4] or "").lower()) + "cyrillic", char)
    latin = {c: n for n, c in found.items()} | {c: n for n, c in NAMED.items()}
    for code in [x for x in range(0xE0, 0x100) if x not in (0xDF, 0xF7)]:
        if (upper := chr(code).upper()) in latin:
            found[f"{latin[upper]}small"] = chr(0xF700 + code)
    return _by_rule() | {n: chr(c) for n, c in PRIVATE.items()} | SYMBOLS | found | NAMED


def parse_glyph_list(text: str) -> dict[str, str]:
    """Glyph name to text from lines of ``name;code code`` with hexadecimal codes; ``#`` begins a remark.

    The rules above give the names of common fonts; a list for others can be
    passed to the sources as ``glyphs``.
    """
    rows = (line.partition(";") for line in text.splitlines() if line.strip() and not line.startswith("#"))
    return {name.strip(): "".join(chr(int(c, 16)) for c in codes.replace(",", " ").split()) for name, _, codes in rows}


@cache
def glyph_names() -> dict[str, str]:
    """Text to its first glyph name."""
    found: dict[str, str] = {}
    for name, text in {**NAMED, **glyph_texts()}.items():
        found.setdefault(text, name)
    return found


def glyph_text(name: str | None, more: dict[str, str] | None = None) -> str | None:
    """The text of a glyph name; null for ``.notdef`` and names that mean nothing. ``more`` names come first.

    ``uni`` with groups of four hexadecimal digits is UTF-16, ``u`` with four to
    six one code point, ``char`` with two one byte; parts after a dot are variants.
    """
    if name is None or name == ".notdef":
        return None
    if (text := (more or {}).get(name, glyph_texts().get(name))) is not None:
        return text
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "surrogatepass")
    if (m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if m := re.fullmatch(r"char([0-9A-Fa-f]{2})", name):
        return chr(int(m[1], 16))
    if "." in name[1:]:
        return glyph_text(name.partition(".")[0], more)
    if "_" in name:
        parts = [glyph_text(p, more) for p in name.split("_")]
        return None if None in parts else "".join(parts)
    return None


def _runs(runs: dict[int, str]) -> dict[int, str]:
    return {first + i: name for first, names in runs.items() for i, name in enumerate(names.split())}


def _codec(codec: str) -> dict[int, str]:
    found = {}
    for code in range(0x20, 0x100):
        try:
            text = bytes([code]).decode(codec)
        except UnicodeDecodeError:
            continue
        if text.isprintable() or text in " ­":
            found[code] = glyph_names().get(text, f"uni{ord(text):04X}")
    return found


@cache
def glyphmap(encoding: str) -> dict[int, str]:
    """Code to glyph name; an unknown encoding is empty."""
    ascii_ = {c: n for c, n in _codec("latin-1").items() if c < 0x7F}
    if encoding == "StandardEncoding":
        return ascii_ | {0x27: "quoteright", 0x60: "quoteleft"} | _runs(STANDARD_UPPER)
    if encoding == "MacRomanEncoding":
        return _codec("mac_roman") | {0xCA: "space", 0xDB: "currency"}
    if encoding == "WinAnsiEncoding":
        return {c: "bullet" for c in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D)} | _codec("cp1252") | {0xA0: "space", 0xAD: "hyphen"}
    if encoding == "PDFDocEncoding":
        return {c: n for c, n in _codec("latin-1").items() if c != 0xAD and c != 0xA0} | _runs(PDFDOC_OWN)
    return {}


ENCODINGS = ("StandardEncoding", "MacRomanEncoding", "WinAnsiEncoding", "PDFDocEncoding")


def encoding_texts(encoding: str) -> dict[int, str]:
    """Code to text."""
    return {code: text for code, name in glyphmap(encoding).items() if (text := glyph_text(name)) is not None}


def expand_differences(items: list) -> dict[int, str]:
    """Code to glyph name from a Differences array: a number sets the code, each name takes the next; the later wins."""
    found: dict[int, str] = {}
    code = 0
    for item in items:
        if isinstance(item, str):
            found[code] = str(item)
            code += 1
        else:
            code = int(item)
    return found


def decode_text(data: bytes) -> str:
    """A text string: UTF-16 after a byte order mark (which stays, as U+FEFF), else the document encoding; codes without text vanish."""
    if data.startswith(b"\xfe\xff"):
        return data[: len(data) // 2 * 2].decode("utf-16-be", "surrogatepass")
    table = encoding_texts("PDFDocEncoding")
    return "".join(chr(b) if b in (9, 10, 13) else table.get(b, "") for b in data)
