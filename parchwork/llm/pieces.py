"""SentencePiece encoding and decoding as weighted transduction.

Three transducers are compiled from a model file and composed with each input:

* the normaliser rewrites the longest key of the model's character map at each
  place, removes extra blanks and adds a dummy one in front where the model
  asks for it, and writes space as U+2581;
* the lexicon is a trie of pieces whose paths accept a piece's characters and
  emit its id at their end;
* the byte fallback accepts a character that is no piece and emits the ids of
  its UTF-8 bytes (or the unknown id, where the model has no fallback).

Composing the last two with a text gives an arc for each place where a path of
the trie ends. The encoding is the shortest path over these arcs in the
tropical semiring: weights add along a path, and of several paths to a place
the least counts. For a unigram model an arc weighs minus the piece's
log-probability. A BPE model has no such weights: its encoding is the outcome
of ranked merges. There the composition carries the last piece in its state,
and an arc weighs 0 if that piece and the next one would not have merged across
their border, infinity otherwise. One path of weight 0 then reaches each place
that a path reaches, and the one to the end is the encoding that the merges
give: merges inside a piece do not depend on what lies outside, so a sequence
of pieces is the outcome of the merges just if each adjacent pair is.

Inputs are cut where no arc can cross: before a U+2581 that follows something
else (if no piece holds such a pair), around characters outside the lexicon's
alphabet, and for BPE between groups of characters that pieces never hold side
by side, such as letters and signs. For unigrams the parts are composed many at
a time, all places of one depth together. For BPE the composition is made only
as far as it is searched: no weight is below 0, so the first path of weight 0
to the end is the shortest. Parts recur; a table of bounded size remembers
those met lately.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm.caches import begin, keep

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters in half the table of parts that a worker remembers; each entry counts ENTRY more.
REMEMBERED, ENTRY = 12_000_000, 20
#: Pairs of pieces whose weights a worker remembers.
PAIRS = 300_000
#: Characters that are composed at a time, and of texts that are encoded together.
STEP, TOGETHER = 200_000, 1_000_000
INFINITY = np.float32(np.inf)


class Normaliser:
    """The compiled character map and the handling of blanks."""

    def __init__(self, spec) -> None:  # noqa: ANN001
        self.dummy, self.remove_extra = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if not spec.escape_whitespaces:
            raise ValueError("only models that write space as U+2581 are supported")
        self.rules = self._rules(spec.precompiled_charsmap)
        self.longest = max(map(len, self.rules), default=0)
        first = "".join(sorted({k[0] for k in self.rules}))
        self.begins = re.compile(f"[{re.escape(first)}]") if first else None

    @staticmethod
    def _rules(packed: bytes) -> dict[str, str]:
        """Keys and what replaces them, from a double-array trie over UTF-8 bytes and the replacements it points to."""
        if not packed:
            return {}
        size = int.from_bytes(packed[:4], "little")
        units = np.frombuffer(packed[4 : 4 + size], dtype="<u4")
        texts = packed[4 + size :]
        base = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        letters = np.arange(1, 256)
        found: dict[str, str] = {}
        stack = [(0, b"")]
        while stack:
            node, key = stack.pop()
            children = node ^ base(int(units[node])) ^ letters
            children = children[children < len(units)]
            labels = children ^ node ^ base(int(units[node]))
            for child, letter in zip(children.tolist(), labels.tolist(), strict=True):
                unit = int(units[child])
                if unit & 0x800000FF != letter:
                    continue
                if unit >> 8 & 1:
                    begin = int(units[child ^ base(unit)]) & 0x7FFFFFFF
                    found[(key + bytes([letter])).decode()] = texts[begin : texts.index(0, begin)].decode()
                stack.append((child, key + bytes([letter])))
        return found

    def rewritten(self, text: str) -> str:
        """The text with the longest key at each place replaced, from left to right."""
        if self.begins is None:
            return text
        out, at = [], 0
        while True:
            hit = self.begins.search(text, at)
            if hit is None:
                return "".join(out) + text[at:]
            begin = hit.start()
            out.append(text[at:begin])
            for end in range(min(begin + self.longest, len(text)), begin, -1):
                if text[begin:end] in self.rules:
                    out.append(self.rules[text[begin:end]])
                    at = end
                    break
            else:
                out.append(text[begin])
                at = begin + 1

    def apply(self, text: str) -> str:
        if not text:
            return ""
        text = self.rewritten(text)
        if self.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        text = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.remove_extra else text


class Lexicon:
    """A trie of pieces as arrays: arcs in order of state and letter, and the piece that ends in each state."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.alphabet = sorted({c for piece in pieces for c in piece})
        self.longest = max(map(len, pieces), default=1)
        self.letter = np.full(max(map(ord, self.alphabet), default=0) + 2, -1, dtype=np.int32)
        self.letter[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet))
        states: dict[str, int] = {"": 0}
        arcs: list[tuple[int, int]] = []
        for piece in sorted(pieces):  # a state for each beginning of a piece
            for end in range(1, len(piece) + 1):
                if piece[:end] not in states:
                    states[piece[:end]] = len(states)
                    arcs.append((states[piece[: end - 1]] * len(self.alphabet) + int(self.letter[ord(piece[end - 1])]), states[piece[:end]]))
        arcs.sort()
        self.arcs, self.targets = np.array([a for a, _ in arcs], dtype=np.int64), np.array([t for _, t in arcs], dtype=np.int32)
        self.ends = np.full(len(states), -1, dtype=np.int32)
        for piece, i in pieces.items():
            self.ends[states[piece]] = i
        self.root = np.full(len(self.alphabet) + 1, -1, dtype=np.int32)  # the first step has no search; the last entry is for no letter
        self.root[self.arcs[: np.searchsorted(self.arcs, len(self.alphabet))]] = self.targets[: np.searchsorted(self.arcs, len(self.alphabet))]

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of characters in the alphabet, -1 for others."""
        return self.letter[np.minimum(codes, len(self.letter) - 1)]

    def compose(self, letters: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Ids of pieces by length - 1 and end, -1 where none; left: characters up to the end of each one's part, itself included."""
        n = len(letters)
        piece = np.full((self.longest, n + 1), -1, dtype=np.int32)
        at, state = np.arange(n), self.root[letters]
        for length in range(1, self.longest + 1):
            alive = state >= 0
            at, state = at[alive], state[alive]
            if not len(at):
                break
            piece[length - 1, at + length] = self.ends[state]
            more = left[at] > length
            at, state = at[more], state[more]
            there = letters[at + length]
            arc = state.astype(np.int64) * len(self.alphabet) + there
            found = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
            state = np.where((there >= 0) & (self.arcs[found] == arc), self.targets[found], -1)
        return piece


class Recent:
    """Encodings by text, of bounded size: a full half becomes the old one, and what is asked for again moves to the new."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def missing(self, texts: set[str]) -> list[str]:
        """Those of ``texts`` to be added; the others can be read from ``young`` until the next call."""
        if self.size > REMEMBERED:
            self.young, self.old, self.size = {}, self.young, 0
        texts = texts.difference(self.young)
        again = texts.intersection(self.old)
        self.add(again, map(self.old.__getitem__, again))
        return list(texts - again)

    def add(self, texts: Collection[str], encoded: Iterable[bytes]) -> None:
        self.young.update(zip(texts, encoded, strict=True))
        self.size += sum(map(len, texts)) + ENTRY * len(texts)


class Transducer:
    """The compiled composition of normaliser, pieces and byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(p.type == USER for p in proto.pieces) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined symbols and blanks at word ends are not supported")
        self.normaliser = Normaliser(proto.normalizer_spec)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = np.array([p.score for p in proto.pieces], dtype=np.float32)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.byte_ids = [0] * 256
        self.fallback = False
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.fallback = True
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == NORMAL:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
        self.normal = [p.type == NORMAL for p in proto.pieces]
        # pieces that merges never give can't be on a path of weight 0
        self.pieces = {p: i for p, i in self.ids.items() if self.kind == UNIGRAM or len(p) == 1 or self._merged(p) == [p]}
        self.unknown_weight = np.float32(10) - min((self.scores[i] for i in self.ids.values()), default=np.float32(0))
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces], dtype=bool)
        alphabet = {c for piece in self.pieces for c in piece}
        if self.kind == UNIGRAM:
            self.lexicon = Lexicon(self.pieces)
        else:
            self.packed = {p: np.int32(i).tobytes() for p, i in self.pieces.items()}
            # the trie: of each beginning of a piece the longest piece that begins it, and of each piece the next shorter one
            self.begun: dict[str, str] = {}
            self.shorter: dict[str, str | None] = {}
            for piece in sorted(self.pieces, key=len):
                for end in range(1, len(piece)):
                    if piece[:end] not in self.begun:
                        self.begun[piece[:end]] = self.begun.get(piece[: end - 1], piece[:1])
                self.shorter[piece] = self.begun.get(piece[:-1])
                self.begun[piece] = piece
            self._pairs: dict[tuple[str, str], bool] = {}
        # where parts may be cut; if U+2581 is only at the beginning of pieces, it begins a part
        if SPACE in alphabet and not any(SPACE in piece.lstrip(SPACE) for piece in self.pieces):
            runs = self._runs(alphabet - {SPACE})
            self.parts = re.compile(f"{SPACE}+(?:{runs})?|{runs}|.", re.DOTALL)
        else:
            self.parts = re.compile(f"{self._runs(alphabet)}|.", re.DOTALL)
        self._known = Recent()

    def _runs(self, letters: set[str]) -> str:
        """A pattern of the strings of ``letters`` that arcs may span; for BPE, pieces link letters side by side in them to groups."""
        if self.kind == UNIGRAM:
            groups, alone = [letters] if letters else [], set()
        else:
            group = {c: {c} for c in letters}
            linked = set()
            for a, b in {piece[i : i + 2] for piece in self.pieces for i in range(len(piece) - 1)}:
                if a in letters and b in letters:
                    linked |= {a, b}
                    small, large = sorted((group[a], group[b]), key=len)
                    if small is not large:
                        large |= small
                        group |= dict.fromkeys(small, large)
            groups, alone = sorted({id(group[c]): group[c] for c in linked}.values(), key=len, reverse=True), letters - linked
        listed = lambda s: f"[{re.escape(''.join(sorted(s)))}]"
        return "|".join([listed(g) + "+" for g in groups] + [listed(alone)] * bool(alone)) or "(?!)"

    # -- weights ---------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """The outcome of the ranked merges on a short string."""
        symbols = list(text)
        ids, scores = self.ids, self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _apart(self, left: str, right: str) -> bool:
        """Whether the BPE pieces ``left`` and ``right`` weigh 0 side by side: no merge crosses their border."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        found = self._pairs[left, right] = self._merged(left + right) == [left, right]
        return found

    # -- shortest paths ----------------------------------------------------------------

    def shortest(self, parts: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, along the shortest path through the composition with each part."""
        if self.kind == BPE:
            return list(map(self._searched, parts))
        out: list[bytes] = []
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= STEP:
                out += self._shortest(held)
                held, size = [], 0
        return out + self._shortest(held) if held else out

    def _searched(self, part: str) -> bytes:
        """The path of weight 0 through a BPE part, depth first and long arcs first.

        Only one such path reaches a place, so a place from which none goes on
        is never tried again.
        """
        found = self.packed.get(part)
        if found is not None:
            return found
        begun, next_shorter, pairs, size = self.begun, self.shorter, self._pairs, len(part)
        path: list[str] = []
        dead: set[int] = set()
        at, last, piece = 0, None, None
        while at < size:
            if piece is None:  # the longest that begins here, or a character that is none
                piece, end = part[at], at + 1
                while end <= size and (longer := begun.get(part[at:end])) is not None:
                    piece = longer
                    end += 1
            end = at + len(piece)
            if end not in dead:
                apart = last is None or pairs.get((last, piece))
                if apart or (apart is None and self._apart(last, piece)):
                    path.append(piece)
                    at, last, piece = end, piece, None
                    continue
            piece = next_shorter.get(piece)
            while piece is None:
                dead.add(at)
                piece = path.pop()
                at -= len(piece)
                last = path[-1] if path else None
                piece = next_shorter.get(piece)
        packed = self.packed
        return b"".join([packed[p] if p in packed else self._emitted(p) for p in path])

    def _shortest(self, parts: list[str]) -> list[bytes]:
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n, longest = len(codes), self.lexicon.longest
        letters = self.lexicon.letters(codes)
        piece = self.lexicon.compose(letters, np.repeat(starts + lengths, lengths) - np.arange(n))
        distance, taken, last = np.full(n + 1, INFINITY), np.zeros(n + 1, dtype=np.int32), np.full(n + 1, -1, dtype=np.int32)
        depth = np.arange(n) - np.repeat(starts, lengths) + 1  # of a place after its character
        # arcs by depth, then by length: of equal paths that with the longest last piece counts
        rows, ends = np.nonzero(piece >= 0)
        lone = np.flatnonzero(piece[0, 1:] < 0) + 1  # after a character that is no piece, but for itself
        ids = np.concatenate([piece[rows, ends], np.full(len(lone), self.unknown, dtype=np.int32)])
        turn = np.concatenate([longest - rows, np.full(len(lone), longest + 1)])
        size, ends = np.concatenate([rows + 1, np.ones(len(lone), dtype=np.int64)]), np.concatenate([ends, lone])
        key = depth[ends - 1] * (longest + 2) + turn
        order = np.argsort(key, kind="stable")
        key, ids, size, ends = key[order], ids[order], size[order], ends[order]
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(key)], strict=True):
            self._relax(ends[lo:hi], int(size[lo]), ids[lo:hi], int(depth[ends[lo] - 1]), distance, taken, last)
        return self._walked(parts, codes, starts, lengths, taken, last)

    def _relax(self, ends: np.ndarray, length: int, ids: np.ndarray, depth: int, distance: np.ndarray, taken: np.ndarray, last: np.ndarray) -> None:
        """Take the arcs of ``length`` characters into ``ends`` that make a path shorter."""
        begins = ends - length
        before = distance[begins] if depth > length else np.zeros(len(ends), dtype=np.float32)
        weight = np.where(ids == self.unknown, self.unknown_weight, -self.scores[ids])
        through = before + weight
        shorter = through < distance[ends]
        ends, ids = ends[shorter], ids[shorter]
        distance[ends], taken[ends], last[ends] = through[shorter], length, ids

    def _walked(self, parts: list[str], codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, taken: np.ndarray, last: np.ndarray) -> list[bytes]:
        """What the paths emit, walking back from the ends of all parts together."""
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        at, owner = (starts + lengths)[lengths > 0], np.flatnonzero(lengths)
        while len(at):
            found.append(np.where(last[at] == self.unknown, -1 - codes[at - 1].astype(np.int64), last[at]))
            owners.append(owner)
            at = at - taken[at]
            more = at > starts[owner]
            at, owner = at[more], owner[more]
        if not found:
            return [b""] * len(parts)
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(found[::-1])
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(parts)))
        plain = ids.astype(np.int32)
        out = [plain[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.unique(owner[ids < 0]).tolist():  # with characters that are no pieces
            mine = ids[ends[i - 1] if i else 0 : ends[i]].tolist()
            out[i] = b"".join([np.int32(k).tobytes() if k >= 0 else self._emitted(chr(-1 - k)) for k in mine])
        return out

    def _emitted(self, character: str) -> bytes:
        """What the byte fallback emits for a character."""
        ids = [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]
        return np.array(ids, dtype=np.int32).tobytes()

    # -- whole texts -------------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, as little-endian 32-bit integers; null gives none."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > TOGETHER:
                out += self._encode_some(held)
                held, size = [], 0
        return out + self._encode_some(held)

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        rows = [self.parts.findall(self.normaliser.apply(text)) for text in texts]
        new = self._known.missing(set().union(*rows))
        self._known.add(new, self.shortest(new))
        out = [b"".join(map(self._known.young.__getitem__, row)) for row in rows]
        return out if self.fallback else [self._joined(x) for x in out]

    def _joined(self, packed: bytes) -> bytes:
        """Without a fallback, neighbouring unknown characters are one unknown id."""
        ids = np.frombuffer(packed, dtype=np.int32)
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; invalid UTF-8 becomes U+FFFD and ids outside the model an error."""
        parts = list(map(self.surface.__getitem__, ids))
        if self.normaliser.dummy or self.normaliser.remove_extra:
            for i, part in enumerate(parts):  # the blank in front, or all of them
                if not self.normal[ids[i]]:
                    if part:
                        break
                    continue
                parts[i] = part.removeprefix(b" ")
                if not self.normaliser.remove_extra or parts[i]:
                    break
        return b"".join(parts).decode("utf-8", "replace")


_loaded: dict[str, tuple[bytes, Transducer]] = {}
keep("pieces", _loaded.clear)


def _transducer(model: bytes, name: str) -> Transducer:
    """One compiled transducer for each model and worker."""
    found = _loaded.get(name)
    if found is None or found[0] != model:
        found = _loaded[name] = (model, Transducer(model))
    return found[1]


def read_model(path: str) -> bytes:
    """The bytes of a model file, read on the driver and sent with the tasks (it is below a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def _flat(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids in one array, and where each row begins, with the end of the last."""
    return np.frombuffer(b"".join(rows), dtype=np.int32), np.cumsum([0] + [len(r) // 4 for r in rows])


def _lists(ids: np.ndarray, ends: np.ndarray, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=null)


def encode(text: Column, model: bytes) -> Column:
    """Ids of a text as an array of integers; null stays null, an empty text gives no ids."""

    @F.arrow_udf("array<int>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("pieces")
        compiled = _transducer(model, "model")
        for texts in batches:
            yield _lists(*_flat(compiled.encode_batch(texts.to_pylist())), texts.is_null())

    return udf(text)


def decode(ids: Column, model: bytes) -> Column:
    """The text of an array of ids; null stays null."""

    @F.arrow_udf("string")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("pieces")
        decode_one = _transducer(model, "model").decode
        for arrays in batches:
            if isinstance(arrays, pa.ChunkedArray):
                arrays = arrays.combine_chunks()
            values, ends, valid = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy(), arrays.is_valid().to_pylist()
            yield pa.array([decode_one(values[a:b].tolist()) if v else None for a, b, v in zip(ends[:-1], ends[1:], valid, strict=True)], pa.string())

    return udf(ids)


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, decoded_ok.

    decoded_ok tells whether decoding the ids gives the text back; it is null
    for a null text, whose ids are null too, and an empty text has no ids.
    Equal rows give equal rows, an empty table none, texts are encoded whole,
    however long, and other columns of ``docs`` are left out.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(name, kind) for name, kind in (("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("n_byte_tokens", T.LongType()), ("decoded_ok", T.BooleanType())))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pieces")
        compiled = _transducer(model, "model")
        for batch in batches:
            texts, null = batch.column("text").to_pylist(), batch.column("text").is_null()
            ids, ends = _flat(compiled.encode_batch(texts))
            bytes_before = np.append(0, np.cumsum(compiled.is_byte[ids]))[ends]
            same = [None if text is None else compiled.decode(ids[a:b].tolist()) == text for text, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            count = lambda before, null=null: pa.array(np.diff(before), pa.int64(), mask=null.to_numpy(zero_copy_only=False))
            columns = [batch.column("doc_id"), _lists(ids, ends, null), count(ends), count(bytes_before), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text").mapInArrow(encoded, schema)
