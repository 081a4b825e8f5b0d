"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

The vocabulary is a rank file (token in base64, blank, id), named by path. Frequent words
of the corpus are compiled into a minimal acyclic transducer: words share prefixes and
suffixes, each edge carries the number of words before it, so the sum along a path is the
word's number, which names its slice of the id pool. The tables are stored as arrays in the
shared folder and memory-mapped by the workers (broadcast, within a bound, where the
folder is not a mounted one). Words that the lexicon lacks are merged exactly. What the
lexicon holds affects speed only, never an id.

A null text and an empty text both give an empty list of ids; blank text is encoded like
any other. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut, local_folder

#: Default place of the vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
#: Most words in the lexicon; its tables stay below some 40 MB.
LEXICON = 32_768
#: Longest word (bytes) in the lexicon.
LONGEST = 24
#: Bytes of text handled together in a worker.
SLICE_BYTES = 1 << 20
#: Most words that the merge memo of a worker keeps.
MEMO = 200_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_cache: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> id of a rank file."""
    if ("ranks", path) not in _cache:
        with open(path, "rb") as f:
            _cache["ranks", path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return _cache["ranks", path]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merge with a heap over a linked list, for very long words."""
    import heapq

    n = len(parts)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or parts[i] + parts[j] != whole:
            continue
        parts[i], alive[j], right[i] = whole, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p, ok in zip(parts, alive) if ok]


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if "classes" not in _cache:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0] if not 0xD800 <= c <= 0xDFFF and (c < 0x20000 or c < 0x33480) else "C"
            if k == "L":
                table[c] = LETTER
            elif k == "N":
                table[c] = NUMBER
        table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _cache["classes"] = table
    return _cache["classes"]


def word_starts(raw: bytes, doc_at: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of concatenated UTF-8 texts start; texts start at ``doc_at``.

    The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, applied to each text apart.
    """
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    if n == len(raw):
        byte_at = None
        first = np.zeros(n, bool)
        first[doc_at[doc_at < n]] = True
    else:
        size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte_at = np.cumsum(size) - size
        first = np.zeros(n, bool)
        at = np.searchsorted(byte_at, doc_at)
        first[at[at < n]] = True
    cls = _classes()[cp]
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    begin = np.flatnonzero(start)
    kind = cls[begin]
    end = np.concatenate((begin[1:], [n]))
    doc_first = first[begin]
    follows = np.concatenate((~doc_first[1:], [False]))  # the next run is in the same text
    # the last white space before a word: a blank joins the word, any other stands alone
    space = kind == SPACE
    tail = space & follows
    last = end[tail] - 1
    start[last] = True
    blank = cp[last] == 32
    start[last[blank] + 1] = False
    # contractions: an apostrophe that no blank precedes, then s t m d re ve ll
    mark = begin[(kind == OTHER) & (cp[begin] == 39)]
    mark = mark[start[mark] & (mark + 1 < n)]
    mark = mark[(cls[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        a = cp[mark + 1]
        two = mark + 2
        ok2 = (two < n) & ~first[np.minimum(two, n - 1)]
        b = np.where(ok2, cp[np.minimum(two, n - 1)], 0)
        one = np.isin(a, [115, 116, 109, 100])
        pair = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        hit = one | pair
        mark, length = mark[hit], np.where(one[hit], 2, 3)
        start[mark + 1] = False
        after = mark + length
        start[after[after < n]] = True
    begin = np.flatnonzero(start)
    return begin.astype(np.int64) if byte_at is None else byte_at[begin]


class Lexicon:
    """Minimal acyclic transducer from words to slices of an id pool."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.kind, self.edge, self.final, self.offset, self.pool = (arrays[k] for k in ("kind", "edge", "final", "offset", "pool"))
        self.width = int(self.kind.max()) + 1

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> Lexicon:
        """Build from sorted words with the incremental minimal construction."""
        order = sorted(w for w in words if w)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        unchecked: list[tuple[int, int, int]] = []
        free: list[int] = []

        def minimise(down_to: int) -> None:
            while len(unchecked) > down_to:
                parent, symbol, child = unchecked.pop()
                key = (final[child], tuple(edges[child].items()))
                same = register.get(key)
                if same is None:
                    register[key] = child
                else:
                    edges[parent][symbol] = same
                    edges[child] = {}
                    free.append(child)

        before = b""
        for word in order:
            common = 0
            while common < min(len(word), len(before)) and word[common] == before[common]:
                common += 1
            minimise(common)
            at = unchecked[-1][2] if unchecked else 0
            for symbol in word[common:]:
                if free:
                    new = free.pop()
                    final[new] = False
                else:
                    new = len(edges)
                    edges.append({})
                    final.append(False)
                edges[at][symbol] = new
                unchecked.append((at, symbol, new))
                at = new
            final[at] = True
            before = word
        minimise(0)
        number: dict[int, int] = {}  # words below each state

        def below(state: int) -> int:
            if state not in number:
                number[state] = int(final[state]) + sum(below(x) for x in edges[state].values())
            return number[state]

        below(0)
        used = sorted({s for w in order for s in w})
        kind = np.zeros(256, np.int32)
        for i, s in enumerate(used):
            kind[s] = i + 1  # 0 is a symbol no word has
        states = sorted(number)
        new_id = {s: i + 1 for i, s in enumerate(states)}  # 0 is the dead state
        width = len(used) + 1
        edge = np.zeros(((len(states) + 1) * width,), np.int64)
        is_final = np.zeros(len(states) + 1, bool)
        for s in states:
            count = int(final[s])
            is_final[new_id[s]] = final[s]
            for symbol in sorted(edges[s]):
                target = edges[s][symbol]
                edge[new_id[s] * width + kind[symbol]] = new_id[target] << 32 | count
                count += number[target]
        ids = [words[w] for w in order]
        offset = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        pool = np.array([i for x in ids for i in x], np.int32)
        return Lexicon({"kind": kind, "edge": edge, "final": is_final, "offset": offset, "pool": pool})

    def arrays(self) -> dict[str, np.ndarray]:
        return {"kind": self.kind, "edge": self.edge, "final": self.final, "offset": self.offset, "pool": self.pool}

    def save(self, folder: str) -> None:
        for name, a in self.arrays().items():
            np.save(os.path.join(folder, name + ".npy"), a)

    @staticmethod
    def load(folder: str) -> Lexicon:
        return Lexicon({name: np.load(os.path.join(folder, name + ".npy"), mmap_mode="r") for name in ("kind", "edge", "final", "offset", "pool")})

    def look_up(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of each word in the lexicon, -1 if it is not there."""
        result = np.full(len(start), -1, np.int64)
        state = np.ones(len(start), np.int64)
        number = np.zeros(len(start), np.int64)
        symbol = self.kind[buf].astype(np.int64)
        live = np.flatnonzero((length > 0) & (length <= LONGEST))
        pos, left, state, number = start[live], length[live], state[live], number[live]
        while len(live):
            step = self.edge[state * self.width + symbol[pos]]
            state = step >> 32
            number = number + (step & 0xFFFFFFFF)
            pos, left = pos + 1, left - 1
            done = left == 0
            if done.any():
                hit = done & self.final[state] & (state > 0)
                result[live[hit]] = number[hit]
            on = ~done & (state > 0)
            live, pos, left, state, number = live[on], pos[on], left[on], state[on], number[on]
        return result


def _slices(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, rows, bytes, text offsets) of pieces of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    k = 0
    while k < len(column):
        m = max(k + 1, int(np.searchsorted(at, at[k] + SLICE_BYTES, "right")) - 1)
        m = min(m, len(column))
        raw = data[int(at[k]) : int(at[m])].to_pybytes() if data is not None and at[m] > at[k] else b""
        yield k, m - k, raw, at[k : m + 1] - at[k]
        k = m


def _split(raw: bytes, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = word_starts(raw, doc_at[:-1])
    end = np.concatenate((start[1:], [len(raw)])) if len(start) else start
    return np.frombuffer(raw, np.uint8), start, end - start


def frequent_words(texts: DataFrame, column: str, most: int = LEXICON) -> list[bytes]:
    """The most frequent words of the corpus; all texts are counted, with combining before the shuffle."""

    def run(batches):
        power = np.ones(SLICE_BYTES + 1, np.uint64)
        power[1:] = _P
        power = np.cumprod(power)
        back = np.ones(SLICE_BYTES + 1, np.uint64)
        back[1:] = np.uint64(pow(int(_P), -1, 1 << 64))
        back = np.cumprod(back)
        seen: dict[int, list] = {}

        def flush():
            if seen:
                rows = [v for v in seen.values() if v[1] > 1] or list(seen.values())[:1]
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in rows], pa.binary()), pa.array([v[1] for v in rows], pa.int64())], ["word", "n"])
                seen.clear()

        for batch in batches:
            for _, _, raw, doc_at in _slices(batch.column(0)):
                buf, start, length = _split(raw, doc_at)
                for base in range(0, len(buf), SLICE_BYTES):  # a very long text is hashed piece by piece
                    piece = buf[base : base + SLICE_BYTES + LONGEST]
                    inside = (start >= base) & (start < base + SLICE_BYTES) & (length <= LONGEST) & (start + length <= base + len(piece))
                    s, n = start[inside] - base, length[inside]
                    if len(piece) > SLICE_BYTES:
                        ok = s + n <= SLICE_BYTES
                        s, n, piece = s[ok], n[ok], piece[:SLICE_BYTES]
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], dtype=np.uint64)))
                    code = (total[s + n] - total[s]) * back[s]
                    code, first, count = np.unique(code, return_index=True, return_counts=True)
                    for c, f, m in zip(code.tolist(), first.tolist(), count.tolist()):
                        v = seen.get(c)
                        if v is None:
                            seen[c] = [piece[s[f] : s[f] + n[f]].tobytes(), m]
                        else:
                            v[1] += m
                if len(seen) > 4 * MEMO:
                    yield from flush()
        yield from flush()

    counted = texts.select(F.col(column)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    # what a hash share of the words can add to the most frequent, so that few rows reach the driver
    shares = 64
    best = Window.partitionBy("share").orderBy(F.desc("n"), "word")
    counted = counted.withColumn("share", F.pmod(F.hash("word"), F.lit(shares))).withColumn("at", F.row_number().over(best)).where(F.col("at") <= 2 * most // shares + 64)
    return [bytes(r[0]) for r in counted.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


class Encoder:
    """Encodes slices of concatenated texts; one per worker."""

    def __init__(self, lexicon: Lexicon, vocabulary: str):
        self.lexicon, self.vocabulary = lexicon, vocabulary
        self.ranks = read_ranks(vocabulary)
        self.memo: dict[bytes, list[int]] = {}
        try:
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
            self.merge = core.encode_single_piece
        except (ImportError, AttributeError):
            self.merge = lambda word: merge_word(word, self.ranks)

    def words(self, raw: bytes, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words before each text, offset in the pool and number of ids of each word, pool)."""
        buf, start, length = _split(raw, doc_at)
        number = self.lexicon.look_up(buf, start, length)
        known = number >= 0
        at = np.where(known, number, 0)
        if len(self.lexicon.offset) > 1:
            offset, size = self.lexicon.offset[at], self.lexicon.offset[at + 1] - self.lexicon.offset[at]
        else:
            offset = size = np.zeros(len(at), np.int64)
        new = np.flatnonzero(~known)
        extra: list[int] = []
        if len(new):
            offset, size = offset.copy(), size.copy()
            place: dict[bytes, tuple[int, int]] = {}
            base, memo = len(self.lexicon.pool), self.memo
            o, z = [], []
            for s, n in zip(start[new].tolist(), length[new].tolist()):
                word = raw[s : s + n]
                got = place.get(word)
                if got is None:
                    ids = memo.get(word)
                    if ids is None:
                        ids = self.merge(word)
                        if len(memo) < MEMO:
                            memo[word] = ids
                    got = place[word] = (base + len(extra), len(ids))
                    extra += ids
                o.append(got[0])
                z.append(got[1])
            offset[new], size[new] = o, z
        pool = np.concatenate((self.lexicon.pool, np.array(extra, np.int32))) if extra else np.asarray(self.lexicon.pool)
        return np.searchsorted(start, doc_at), offset, size, pool


def _worker(source, vocabulary: str) -> Encoder:
    key = ("encoder", source if isinstance(source, str) else source.value["key"], vocabulary)
    if key not in _cache:
        for old in [k for k in _cache if k[0] == "encoder"]:
            del _cache[old]
        _cache[key] = Encoder(Lexicon.load(source) if isinstance(source, str) else Lexicon(source.value), vocabulary)
    return _cache[key]


def build_lexicon(texts: DataFrame, column: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON):
    """Compile the frequent words and put them where the workers map them: a folder, or a broadcast."""
    ranks = read_ranks(vocabulary)
    lexicon = Lexicon.compile({w: merge_word(w, ranks) for w in frequent_words(texts, column, most)})
    spark = texts.sparkSession
    folder = local_folder(spark)
    if folder:
        lexicon.save(folder)
        return folder
    import uuid

    return spark.sparkContext.broadcast(lexicon.arrays() | {"key": uuid.uuid4().hex})


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY, lexicon=None) -> DataFrame:
    """(key, ids array<int>): one row per row of ``df``; null and empty text give an empty list."""
    source = lexicon or build_lexicon(df, column, vocabulary)

    def run(batches):
        encoder = _worker(source, vocabulary)
        for batch in batches:
            for k, rows, raw, doc_at in _slices(batch.column(1)):
                word_at, offset, size, pool = encoder.words(raw, doc_at)
                total = np.concatenate(([0], np.cumsum(size)))
                where = np.repeat(offset - total[:-1], size) + np.arange(total[-1])
                ids = pa.ListArray.from_arrays(pa.array(total[word_at].astype(np.int32)), pa.array(pool[where], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, rows), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], column: str = "text", vocabulary: str = VOCABULARY, lexicon=None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint, 0 for null and empty text), one row per row."""
    source = lexicon or build_lexicon(df, column, vocabulary)

    def run(batches):
        encoder = _worker(source, vocabulary)
        for batch in batches:
            for k, rows, raw, doc_at in _slices(batch.column(0)):
                word_at, _, size, _ = encoder.words(raw, doc_at)
                total = np.concatenate(([0], np.cumsum(size)))
                n = np.diff(total[word_at])
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + i).slice(k, rows) for i in range(len(keep))), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    flat = df.select(F.col(column).alias("_text"), *keep)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return flat.mapInArrow(run, schema + ", n_tokens long")


def token_counts(df: DataFrame, keep: list[str], column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``count_tokens``, computed once and kept in the shared folder (texts are left behind)."""
    return cut(count_tokens(df, keep, column, vocabulary))
