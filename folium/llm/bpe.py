"""Operator 5: BPE encoding through a minimal acyclic transducer of frequent words.

A text is cut at runs of white space into pieces (a piece keeps the space before it), and
the pattern of the vocabulary cuts each piece into words, exactly as on the whole text.
Frequent words are compiled into a minimal automaton: states with equal futures are
shared, and every transition counts the words before it, so the path of a word adds
up to its index (its output), under which its ids are stored.  Each Python worker
maps the compiled file into memory.  A word that the automaton lacks is merged by the
ranked merges of the vocabulary, so the result never depends on what is in it.

Frequent words come from the whole corpus: each task keeps a summary of ``SUMMARY``
counters (every word with over 1/``SUMMARY`` of the task's words survives), the summaries
are added, and those above the least count that at most ``LEXICON`` exceed are compiled.

Decoding looks the bytes of every id up and joins them.

Defined cases: null and empty texts have no ids and decode to the empty text; the
vocabulary's added token is one id where its string occurs in a text; repeated rows
encode alike; a text of any length is encoded whole; an empty table gives an empty
result; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.common import text_of

LEXICON = 50_000
SUMMARY = 1 << 15
#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
#: Pieces whose ids a worker keeps; cleared when full.
KEPT = 1 << 18
#: Characters of the texts whose unseen pieces are learned together.
AT_A_TIME = 1 << 20
#: White space of Unicode, as the pattern's \s means it.
_WS = "\t-\r \x85\xa0  -     　"
_CLOSERS = frozenset(".,;:!?")
PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = {c: b for b, c in enumerate(_byte_letters())}
        raw = lambda t: bytes(letters[c] for c in t)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The merges as arrays: sorted keys of id pairs, their ranks and what they make.
        keys = np.array([(self.ids[a] << 20) | self.ids[b] for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array(list(self.ranks.values()), dtype=np.int32)[order]
        self.pair_made = np.array([self.ids[a + b] for a, b in self.ranks], dtype=np.int32)[order]
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.bytes = {i: t for t, i in self.ids.items()}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked pair merges first, leftmost on ties."""
        whole = self.ids.get(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        if whole is not None and len(parts) < 2:
            return [whole]
        ranks = self.ranks
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE`` where it does not merge) and its place in the arrays."""
        keys = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        ok = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_ranks[at], NONE), at

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` for many words at a time, as little-endian 32-bit ids.

        Words of similar length are rows of a matrix; each step finds the leftmost pair of
        least rank of every row, merges it and closes the gap."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            pick = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(pick), 4096):
                self._merge_block(words, pick[at : at + 4096], high, out)
        for i in np.flatnonzero(length > 64).tolist():
            out[i] = np.asarray(self.merge(words[i]), dtype="<u4").tobytes()
        return out

    def _merge_block(self, words: list[bytes], pick: np.ndarray, width: int, out: list[bytes]) -> None:
        n = len(pick)
        if not n:
            return
        chars = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in pick]), dtype=np.uint8).reshape(n, width)
        size = np.array([len(words[i]) for i in pick])
        ids = np.full((n, width + 1), -1, dtype=np.int32)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.byte_ids[chars], -1)
        rank = np.full((n, width + 1), NONE, dtype=np.int32)
        rank[:, :width] = self._pairs(ids[:, :-1], ids[:, 1:])[0]
        live = np.arange(n)
        cols = np.arange(width)
        while len(live):
            r = rank[live]
            best = r.argmin(axis=1)
            going = r[np.arange(len(live)), best] < NONE
            live, best = live[going], best[going]
            if not len(live):
                break
            _, at = self._pairs(ids[live, best], ids[live, best + 1])
            made = self.pair_made[at]
            # Columns after the merged pair move one to the left.
            source = cols + (cols > best[:, None])
            row = live[:, None]
            moved, moved_rank = ids[row, source], rank[row, source]
            moved[np.arange(len(live)), best] = made
            size[live] -= 1
            after = np.where(best + 1 < width, moved[np.arange(len(live)), np.minimum(best + 1, width - 1)], -1)
            moved_rank[np.arange(len(live)), best] = self._pairs(made, after)[0]
            has = best > 0
            k = np.flatnonzero(has)
            moved_rank[k, best[k] - 1] = self._pairs(moved[k, best[k] - 1], made[k])[0]
            ids[live, :width], rank[live, :width] = moved, moved_rank
        flat = ids[:, :width].astype("<u4")
        for row, i in enumerate(pick.tolist()):
            out[i] = flat[row, : size[row]].tobytes()

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same order with a heap and a linked list, for words of many bytes."""
        import heapq

        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        end, ranks, heap = len(parts), self.ranks, []

        def push(i: int) -> None:
            j = after[i]
            if j < end and (r := ranks.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(end - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= end or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [self.ids[p] for p in parts if p]


class Transducer:
    """A minimal acyclic automaton over bytes whose paths add up to word indices.

    Arrays: per state the first transition and whether a word ends there; per
    transition its byte, target and the words that sort before it from the state.
    Ids of word k are ``out[first[k]:first[k + 1]]``.
    """

    FIELDS = ("begin", "final", "label", "target", "skip", "first", "out")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])
        # Plain lists of the root's transitions speed the first step up.
        self.size = len(self.first) - 1

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """Words must be sorted and distinct.  States are shared as soon as no later
        word can extend them, so the automaton is minimal at every step."""
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple]] = []

        def settle(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path = [[False, []]]  # open states of the last word: [final, transitions]
        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for k in range(len(last), common, -1):
                path[k - 1][1].append((last[k - 1], settle(path.pop())))
            path += [[False, []] for _ in range(len(word) - common)]
            path[len(word)][0] = True
            last = word
        for k in range(len(last), 0, -1):
            path[k - 1][1].append((last[k - 1], settle(path.pop())))
        root = settle(path[0])
        count = [0] * len(done)
        for s, (final, moves) in enumerate(done):  # targets are settled before sources
            count[s] = int(final) + sum(count[t] for _, t in moves)
        begin, label, target, skip = [0], [], [], []
        for final, moves in done:
            at = int(final)
            for b, t in moves:
                label.append(b)
                target.append(t)
                skip.append(at)
                at += count[t]
            begin.append(len(label))
        arrays = {
            "begin": np.array(begin + [root], dtype=np.int32),
            "final": np.array([f for f, _ in done], dtype=np.int32),
            "label": np.array(label, dtype=np.int32),
            "target": np.array(target, dtype=np.int32),
            "skip": np.array(skip, dtype=np.int32),
            "first": np.cumsum([0, *map(len, ids)]).astype(np.int32),
            "out": np.array([i for x in ids for i in x], dtype=np.int32),
        }
        return cls(arrays)

    def dump(self) -> bytes:
        sizes = np.array([len(getattr(self, k)) for k in self.FIELDS], dtype=np.int32)
        return b"".join([sizes.tobytes(), *(np.ascontiguousarray(getattr(self, k)).tobytes() for k in self.FIELDS)])

    @classmethod
    def load(cls, buffer) -> Transducer:
        n = len(cls.FIELDS)
        sizes = np.frombuffer(buffer, dtype=np.int32, count=n)
        at, arrays = 4 * n, {}
        for k, size in zip(cls.FIELDS, sizes.tolist(), strict=True):
            arrays[k] = np.frombuffer(buffer, dtype=np.int32, count=size, offset=at)
            at += 4 * size
        return cls(arrays)

    @classmethod
    def mapped(cls, content: bytes) -> Transducer:
        """Map the compiled automaton from an unnamed file of this worker."""
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            return cls.load(mmap.mmap(f.fileno(), len(content), access=mmap.ACCESS_READ))

    def index(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 where the automaton lacks it; all words step together."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not self.size:
            return out
        length = np.fromiter(map(len, words), dtype=np.int64, count=n)
        at = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        keys = self._keys()
        live = np.arange(n)
        state = np.full(n, self.begin[-1], dtype=np.int64)
        total = np.zeros(n, dtype=np.int64)
        step = 0
        while len(live):
            ended = length[live] == step
            fin = live[ended]
            good = fin[self.final[state[fin]] == 1]
            out[good] = total[good]
            live = live[~ended]
            want = state[live] * 256 + flat[at[live] + step]
            k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = keys[k] == want
            live, k = live[ok], k[ok]
            total[live] += self.skip[k]
            state[live] = self.target[k]
            step += 1
        return out

    def _keys(self) -> np.ndarray:
        """Transitions as state * 256 + byte; sorted, as both grow along the arrays."""
        if not hasattr(self, "_k"):
            owner = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.begin[:-1]))
            self._k = owner * 256 + self.label
        return self._k

    def ids_of(self, k: int) -> np.ndarray:
        return self.out[self.first[k] : self.first[k + 1]]


def plain_words(piece: str) -> list[str] | None:
    """Words of a piece of the two common shapes, which need no pattern; else None."""
    body = piece[1:] if piece[0] == " " else piece
    if body.isalpha():
        return [piece]
    if body[-1:] in _CLOSERS and body[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return None


class Encoder:
    """Encodes and decodes whole texts; holds a bounded memo of pieces."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        import regex

        self.v, self.t = vocabulary, transducer
        self.words = regex.compile(WORD_PATTERN)
        self.added = re.compile("|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.memo: dict[str, bytes] = {}
        self.t_out = transducer.out.astype("<u4").tobytes()
        size = max(vocabulary.bytes) + 1
        self.pieces = [vocabulary.bytes.get(i, b"") for i in range(size)]

    def _learn(self, new: list[str]) -> None:
        """Ids of unseen pieces: the automaton first, merges for what it lacks."""
        cut = list(map(self._cut, new))
        names = list({w for c in cut for w in c})
        words = [w.encode("utf-8", "surrogatepass") for w in names]
        index = self.t.index(words)
        first, ids = self.t.first, {}
        known = np.flatnonzero(index >= 0)
        at = index[known]
        for k, a, b in zip(known.tolist(), (4 * first[at]).tolist(), (4 * first[at + 1]).tolist(), strict=True):
            ids[names[k]] = self.t_out[a:b]
        rest = np.flatnonzero(index < 0).tolist()
        ids.update(zip([names[k] for k in rest], self.v.merge_many([words[k] for k in rest]), strict=True))
        for p, c in zip(new, cut, strict=True):
            self.memo[p] = ids[c[0]] if len(c) == 1 else b"".join([ids[w] for w in c])

    def _cut(self, piece: str) -> list[str]:
        return plain_words(piece) or self.words.findall(piece)

    def _parts(self, text: str) -> list:
        """A text as piece lists and the added tokens between them."""
        if self.added is None or not self.added.search(text):
            return [PIECE.findall(text)]
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [PIECE.findall(text[at : m.start()]), np.asarray([self.v.added[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return [*out, PIECE.findall(text[at:])]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Unseen pieces of all the texts are learned together."""
        parts = [self._parts(t or "") for t in texts]
        memo = self.memo
        if len(memo) > KEPT:
            memo.clear()
        new: set[str] = set()
        for text in parts:
            for part in text:
                if isinstance(part, list):
                    new.update(set(part).difference(memo))
        if new:
            self._learn(list(new))
        join = lambda part: part if isinstance(part, bytes) else b"".join(map(memo.__getitem__, part))
        return [b"".join(map(join, text)) for text in parts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """``encode_many`` over runs of texts of about ``AT_A_TIME`` characters."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= AT_A_TIME:
                out += self.encode_many(held)
                held, size = [], 0
        return out + self.encode_many(held)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent pieces of a task: counters are lowered whenever they are too many."""
    counts: Counter = Counter()

    def lower() -> None:
        least = sorted(counts.values(), reverse=True)[SUMMARY]
        kept = {k: n - least for k, n in counts.items() if n > least}
        counts.clear()
        counts.update(kept)

    for batch in batches:
        for text in batch.column(0):
            counts.update(PIECE.findall(text.as_py()))
            if len(counts) > 4 * SUMMARY:
                lower()
    if len(counts) > SUMMARY:
        lower()
    yield pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["piece", "n"]
    )


def frequent_words(docs: DataFrame, size: int = LEXICON, text_col: str = "text") -> list[str]:
    """The pieces that the summaries count most, ``size`` at most.

    The cut is made on counts: a histogram of them (some hundred cells, eight to an octave) gives
    the least count that at most ``size`` pieces reach, so tasks return those pieces alone."""
    summed = docs.select(text_of(text_col).alias("_t")).mapInArrow(_summaries, "piece string, n long")
    summed = summed.groupBy("piece").agg(F.sum("n").alias("n"))
    cells = summed.groupBy(F.floor(8 * F.log2("n")).alias("c")).agg(F.count("*").alias("k"), F.min("n").alias("least"))
    above = cells.select("least", F.sum("k").over(Window.orderBy(F.desc("c"))).alias("k"))
    cut = above.where(F.col("k") <= size).agg(F.min("least").alias("cut"))  # one row
    return sorted(r["piece"] for r in summed.join(F.broadcast(cut), F.col("n") >= F.col("cut")).select("piece").collect())


def build_transducer(vocabulary: Vocabulary, pieces: list[str]) -> Transducer:
    import regex

    pattern = regex.compile(WORD_PATTERN)
    words = sorted({w.encode("utf-8", "surrogatepass") for p in pieces for w in pattern.findall(p)})
    return Transducer.compile(words, [vocabulary.merge(w) for w in words])


class Codec:
    """What tasks need to encode: the vocabulary file's content and the automaton.

    With ``size`` 0 the corpus is not counted and every unseen word is merged."""

    def __init__(self, docs: DataFrame, vocabulary_path: str | None = None, text_col: str = "text", size: int = LEXICON):
        with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as f:
            content = f.read()
        frequent = frequent_words(docs, size, text_col) if size else []
        built = build_transducer(Vocabulary(content), frequent)
        self.shared = docs.sparkSession.sparkContext.broadcast((content, built.dump()))

    def encoder(self) -> Encoder:
        """The encoder of this worker, built once for all its tasks."""
        content, compiled = self.shared.value
        held = Codec._held
        if held is None or held[0] != content or held[1] != compiled:
            held = Codec._held = (content, compiled, Encoder(Vocabulary(content), Transducer.mapped(compiled)))
        return held[2]

    _held: tuple | None = None


def encode_documents(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """id, n_tokens and digests of every row, with the ids themselves if asked for."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for b in batches:
            n, digest, decoded, kept = [], [], [], []
            for found in encoder.encode_batch(b.column(1).to_pylist()):
                n.append(len(found) // 4)
                digest.append(hashlib.sha256(found).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(found).encode("utf-8", "surrogatepass")).hexdigest())
                kept.append(found if ids else b"")
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
