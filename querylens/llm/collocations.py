"""Phrase collocations: exact counts of words and phrases from HAT-tries, and
the phrases whose words occur together more often than apart.

Counting.  A task keeps a HAT-trie per language (Askitis & Sinha 2007): a
shallow trie over word ids, whose leaves are hash containers from the rest
of a phrase to its count.  A container of more than ``BURST`` entries bursts:
its phrases move into containers one word further down.  When the tries hold
``ENTRIES`` entries the largest subtrees are spilled as a whole, as sorted
runs of ``(phrase, count)``, cut by prefix partition: a hash of the language
and the phrase's first two words, so that the rests of a frequent first word
spread over all partitions.  The number of partitions follows the bytes of the
texts (``PARTITION_BYTES`` each); a run is cut into ``FAN`` at most, and where
that is too few, the runs of a partition are merged in pieces and cut again,
level by level.  A last partition's runs are merged by a sort that starts from
the sorted runs, and only phrases of at least ``min_count`` occurrences go on;
every number a score needs is at least that large.

Scoring is ordinary joins and aggregates over those phrases.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, map_arrow, materialise, shuffle_partitions
from .words import mix, string_bytes

BURST = 2_048
ENTRIES = 400_000
ID_BITS = 18
WORDS_KNOWN = 180_000
PARTITION_BYTES = 16 << 20
FAN = 256
STRETCH = 1 << 17
MERGE_ROWS = 1_000_000
MIN_COUNT, TOP, SCALE, COVER = 10, 2_000, 1_000_000, 50
NO_LANG = "und"
SALTS = 64

#: Fixed value: characters that end a piece; tabs and blanks end a word.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PIECES = bytes.maketrans(ENDS, b"," * len(ENDS))
_AHEAD = re.compile(rb"[ \t]*[^ \t]+[ \t]+[^ \t]+")
_BLANK = re.compile(rb"[ \t]")


# ---- counting --------------------------------------------------------------

class HatTrie:
    """Counts of words and phrases of up to three word ids (from 1 on, under
    ``2 ** ID_BITS``).

    ``leaf[a]`` is the container below first word ``a``: ``b << ID_BITS | c`` ->
    count (``c`` 0 for two words, 0 for the word itself).  After it burst,
    ``inner[a]`` holds a container per second word: ``c`` -> count."""

    def __init__(self):
        self.leaf: dict[int, dict[int, int]] = {}
        self.inner: dict[int, dict[int, dict[int, int]]] = {}
        self.size: dict[int, int] = {}     # entries below a burst word
        self.entries = 0

    def add(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Count every word ``a`` with the words ``b`` and ``c`` behind it (0: none)."""
        two = (a > 0) & (b > 0)
        three = two & (c > 0)
        a, b, c = a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)
        first, second = a << 2 * ID_BITS, b << ID_BITS
        found, times = np.unique(np.concatenate([first[a > 0], (first | second)[two], (first | second | c)[three]]), return_counts=True)
        heads, rest = found >> 2 * ID_BITS, (found & ((1 << 2 * ID_BITS) - 1)).tolist()
        cuts = np.flatnonzero(np.diff(heads, prepend=-1))
        times, leaf = times.tolist(), self.leaf
        for word, i, j in zip(heads[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rest)]):
            box = leaf.get(word)
            if box is None:
                box = leaf[word] = dict(zip(rest[i:j], times[i:j]))
                self.entries += j - i
            elif word in self.inner:
                self._add_deep(word, box, rest[i:j], times[i:j])
                continue
            else:
                before = len(box)
                for key, n in zip(rest[i:j], times[i:j]):
                    box[key] = box.get(key, 0) + n
                self.entries += len(box) - before
            if len(box) > BURST:
                self.burst(word)

    def _add_deep(self, word: int, box: dict, rest: list[int], times: list[int]) -> None:
        below, new = self.inner[word], 0
        for key, n in zip(rest, times):
            if not key:
                box[0] += n
                continue
            deep = below.setdefault(key >> ID_BITS, {})
            before = len(deep)
            key &= (1 << ID_BITS) - 1
            deep[key] = deep.get(key, 0) + n
            new += len(deep) - before
        self.size[word] += new
        self.entries += new

    def burst(self, word: int) -> None:
        box = self.leaf[word]
        below = self.inner[word] = {}
        for key, n in box.items():
            if key:
                below.setdefault(key >> ID_BITS, {})[key & ((1 << ID_BITS) - 1)] = n
        self.size[word] = len(box) - 1
        self.leaf[word] = {0: box[0]}

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, entries of their subtrees)."""
        words = np.fromiter(self.leaf, np.int64, len(self.leaf))
        sizes = np.fromiter(map(len, self.leaf.values()), np.int64, len(words))
        if self.size:
            deep = np.zeros(int(words.max()) + 1, np.int64)
            deep[list(self.size)] = list(self.size.values())
            sizes += deep[words]
        return words, sizes

    def take(self, words: list[int]) -> tuple[np.ndarray, ...]:
        """Remove subtrees; returns (a, b, c, count) of their entries."""
        rest, times, heads, sizes = [], [], [], []
        for a in words:
            box = self.leaf.pop(a)
            rest.extend(box)
            times.extend(box.values())
            heads.append(a << 2 * ID_BITS)
            sizes.append(len(box))
            if self.size.pop(a, None) is not None:
                for b, deep in self.inner.pop(a).items():
                    rest.extend(deep)
                    times.extend(deep.values())
                    heads.append(a << 2 * ID_BITS | b << ID_BITS)
                    sizes.append(len(deep))
        self.entries -= len(rest)
        key = np.array(rest, np.int64) | np.repeat(np.array(heads, np.int64), sizes)
        low = (1 << ID_BITS) - 1
        return key >> 2 * ID_BITS, key >> ID_BITS & low, key & low, np.array(times, np.int64)


class _Ids(dict):
    """Word -> id; ends of pieces are 0."""

    def __init__(self):
        super().__init__({b",": 0})
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(zlib.crc32(word))
        return i


def prefix_hash(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a language and a phrase's first two words, given their CRC-32
    (the second plus one; 0 for none)."""
    with np.errstate(over="ignore"):
        return mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                   + np.uint64(zlib.crc32(lang.encode())))


class Counter:
    """Tries of all languages over one word table, with spilling."""

    def __init__(self, partitions: int):
        self.partitions = partitions
        self.waiting: defaultdict[str, list[bytes]] = defaultdict(list)
        self.bytes: defaultdict[str, int] = defaultdict(int)
        self.totals: defaultdict[str, int] = defaultdict(int)
        self.forget()

    def forget(self) -> None:
        self.tries: defaultdict[str, HatTrie] = defaultdict(HatTrie)
        self.ids = _Ids()

    def count(self, lang: str, text: bytes):
        """Count a text's words and phrases; yields the runs this spills."""
        if len(text) < STRETCH:
            self.waiting[lang].append(text)
            self.bytes[lang] += len(text) + 1
            if self.bytes[lang] >= STRETCH:
                yield from self.flush(lang)
        else:
            for part, ahead in stretches(text):
                self._add(lang, part, ahead)
                yield from self._full()

    def flush(self, lang: str):
        self._add(lang, b",".join(self.waiting.pop(lang, [])), b"")
        self.bytes[lang] = 0
        yield from self._full()

    def finish(self):
        """The runs of everything not spilled yet."""
        for lang in list(self.waiting):
            yield from self.flush(lang)
        yield from self.spill(True)

    def _add(self, lang: str, text: bytes, ahead: bytes) -> None:
        found = words_of(text)
        n = len(found)
        found += words_of(ahead)
        found += (b",", b",")
        ids = np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found))
        self.totals[lang] += int(np.count_nonzero(ids[:n]))
        self.tries[lang].add(ids[:n], ids[1:n + 1], ids[2:n + 2])

    def _full(self):
        if len(self.ids.words) > WORDS_KNOWN:
            yield from self.spill(True)
        elif sum(t.entries for t in self.tries.values()) > ENTRIES:
            yield from self.spill()

    def spill(self, everything: bool = False):
        """Sorted runs (lang, partition, phrases, counts) of the largest
        subtrees, until half of ``ENTRIES`` is left; of all at the end, or when
        the word table is full."""
        langs = [lang for lang, trie in self.tries.items() if trie.leaf]
        trees = [self.tries[lang].subtrees() for lang in langs]
        if langs:
            sizes = np.concatenate([s for _, s in trees])
            least = 0
            if not everything:
                down = np.sort(sizes)[::-1]
                left = int(sizes.sum()) - np.cumsum(down)
                least = int(down[min(np.searchsorted(-left, -(ENTRIES // 2)), len(down) - 1)])
            words = pa.array(self.ids.words, pa.large_binary())
            hashes = np.array(self.ids.hashes, np.uint64)
            for lang, (heads, own) in zip(langs, trees):
                some = heads[own >= least].tolist()
                if some:
                    yield from self._runs(lang, words, hashes, *self.tries[lang].take(some))
        if everything:
            self.forget()

    def _runs(self, lang: str, words: pa.Array, hashes: np.ndarray, a, b, c, times):
        part = (prefix_hash(lang, hashes[a], np.where(b > 0, hashes[b] + np.uint64(1), np.uint64(0))) % np.uint64(self.partitions)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        a, b, c, times, part = a[order], b[order], c[order], times[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(part)]):
            phrases = _phrases(words, a[i:j], b[i:j], c[i:j])
            order = pc.sort_indices(phrases)
            yield lang, int(part[i]), phrases.take(order), times[i:j][order.to_numpy()]


def words_of(text: bytes) -> list[bytes]:
    """Words of a text; an end of a piece is a word of its own."""
    return text.lower().translate(_PIECES).replace(b",", b" , ").split()


def _phrases(words: pa.Array, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.Array:
    """The phrases of one to three words as one array (in no order)."""
    parts, places = [], []
    for use, ids in ((b == 0, (a,)), ((b > 0) & (c == 0), (a, b)), (c > 0, (a, b, c))):
        at = np.flatnonzero(use)
        if len(at):
            cols = [words.take(pa.array(x[at])) for x in ids]
            parts.append(cols[0] if len(cols) == 1 else pc.binary_join_element_wise(*cols, pa.scalar(b" ", pa.large_binary())))
            places.append(at)
    back = np.empty(len(a), np.int64)
    back[np.concatenate(places)] = np.arange(len(a))
    return pa.concat_arrays(parts).take(pa.array(back))


def stretches(text: bytes):
    """Parts of a long text of about ``STRETCH`` bytes, cut between words, each
    with the words that follow it (two, or up to the end of the text): phrases
    that start in a part may end there."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = blank.start() if blank else len(text)
        ahead = _AHEAD.match(text, end)
        yield text[at:end], (ahead.group() if ahead else text[end:])
        at = end


_RUNS = "lang string, part int, total long, words binary, lengths binary, counts binary"


def _packed_run(phrases: pa.Array, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A run as three compressed columns: bytes, lengths, counts."""
    _, offsets, data = phrases.buffers()
    at = np.frombuffer(offsets, np.int64, len(phrases) + 1, 8 * phrases.offset)
    shape = [data.to_pybytes()[at[0]:at[-1]] if data else b"", np.diff(at).astype("<u4").tobytes(), counts.astype("<i8").tobytes()]
    return tuple(pa.compress(x, "zstd", asbytes=True) + len(x).to_bytes(8, "little") for x in shape)


def _open_run(packed: bytes) -> bytes:
    return pa.decompress(packed[:-8], int.from_bytes(packed[-8:], "little"), "zstd", asbytes=True)


def _run_table(words: bytes, lengths: bytes, counts: bytes) -> tuple[pa.Array, np.ndarray]:
    """(phrases, counts) of a packed run."""
    data, size = _open_run(words), np.frombuffer(_open_run(lengths), "<u4")
    offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return phrases, np.frombuffer(_open_run(counts), "<i8")


def merged(runs: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """One sorted run of distinct phrases from several sorted runs."""
    if len(runs) == 1:
        return runs[0]
    phrases = pa.chunked_array([p for p, _ in runs])
    order = pc.sort_indices(phrases)          # merges chunks, each of which is sorted
    phrases = phrases.take(order).combine_chunks()
    counts = np.concatenate([n for _, n in runs])[order.to_numpy()]
    if len(phrases) < 2:
        return phrases, counts
    new = np.concatenate([[True], pc.not_equal(phrases[1:], phrases[:-1]).to_numpy(zero_copy_only=False)])
    at = np.flatnonzero(new)
    return phrases.take(pa.array(at)), np.add.reduceat(counts, at)


def _count_runs(docs: DataFrame, partitions: int) -> DataFrame:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["lang", "part", "total", "words", "lengths", "counts"])

    def run(batches):
        counter = Counter(partitions)
        for some in batches:
            data, offs = string_bytes(some.column(1))
            blob = memoryview(data)
            for lang, a, b in zip(some.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                rows = [(x, part, None, *_packed_run(p, n)) for x, part, p, n in counter.count(lang, bytes(blob[a:b]))]
                if rows:
                    yield batch(rows)
        rows = [(x, part, None, *_packed_run(p, n)) for x, part, p, n in counter.finish()]
        rows += [(lang, -1, n, None, None, None) for lang, n in counter.totals.items()]
        if rows:
            yield batch(rows)

    return map_arrow(docs, run, _RUNS)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, words, f`` for all phrases of one to three words with
    at least ``min_count`` occurrences; ``lang, n``, all word occurrences).

    Texts have A-Z lower-cased, are split into pieces at ``. , ; : ! ?`` and
    line ends, and those into words at blanks and tabs.  Null texts count as
    empty, a null language as ``und``; a language without words has no row.
    Every row counts, repeated ones too.  Other columns are not read.
    """
    src = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), as_text(text).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fans = _fans(size // PARTITION_BYTES + 1, shuffle_partitions(docs.sparkSession))
    runs = materialise(_count_runs(src, fans[0]), "phrase-runs")
    totals = runs.where("total > 0").groupBy("lang").agg(F.sum("total").alias("n"))
    runs, parts = runs.where("part >= 0").drop("total"), fans[0]
    for fan in fans[1:]:
        # pieces of a partition's runs: about as many bytes as a last partition holds
        pieces = max(1, size // (parts * PARTITION_BYTES))
        runs = materialise(_cut_again(runs, parts, fan, pieces), "phrase-runs")
        parts *= fan
    return materialise(_counts(runs, min_count), "phrase-counts"), totals


def _fans(partitions: int, least: int) -> list[int]:
    """Cuts per level that give at least ``partitions`` (or ``least``) in all."""
    fans = [min(FAN, max(partitions, least))]
    while np.prod(fans, dtype=float) < partitions:
        fans.append(min(FAN, int(-(-partitions // np.prod(fans, dtype=object)))))
    return fans


def _dealt(runs: DataFrame, pieces: int = 1) -> DataFrame:
    """A partition's runs of a language next to each other."""
    piece = F.pmod(F.xxhash64("words"), F.lit(pieces))
    keyed = runs.select(F.xxhash64("lang", "part", piece).alias("k"), "part", "lang", "words", "lengths", "counts")
    return keyed.repartition(shuffle_partitions(runs.sparkSession), "k").sortWithinPartitions("k", "part", "lang")


def _merged_groups(batches):
    """(part, language, phrases, counts) of the rows of each key, merged as
    they come: in memory are the phrases so far and as many new ones."""
    key, done, waiting, size = None, None, [], 0
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("k", "part", "lang")))
        for k, *run in zip(keys, *(batch.column(c) for c in ("words", "lengths", "counts"))):
            if k != key or size > max(MERGE_ROWS, 0 if done is None else len(done[1])):
                if waiting:
                    done = merged(([done] if done else []) + waiting)
                if k != key and done:
                    yield *key[1:], *done
                    done = None
                key, waiting, size = k, [], 0
            waiting.append(_run_table(*(x.as_py() for x in run)))
            size += len(waiting[-1][1])
    if waiting:
        done = merged(([done] if done else []) + waiting)
    if done:
        yield *key[1:], *done


def _cut_again(runs: DataFrame, parts: int, fan: int, pieces: int) -> DataFrame:
    """Runs of ``parts`` partitions merged in pieces and cut into ``fan`` each."""
    def run(batches):
        for part, lang, phrases, counts in _merged_groups(batches):
            heads = [p.split(b" ", 2)[:2] for p in phrases.to_pylist()]
            first = np.fromiter((zlib.crc32(h[0]) for h in heads), np.uint64, len(heads))
            second = np.fromiter((zlib.crc32(h[1]) + 1 if len(h) > 1 else 0 for h in heads), np.uint64, len(heads))
            spot = (prefix_hash(lang, first, second) // np.uint64(parts) % np.uint64(fan)).astype(np.int64)
            order = np.argsort(spot, kind="stable")
            cuts = np.flatnonzero(np.diff(spot[order], prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                packed = _packed_run(phrases.take(pa.array(own)), counts[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.array([part + parts * int(spot[own[0]])], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)],
                    names=["lang", "part", "words", "lengths", "counts"])

    return map_arrow(_dealt(runs, pieces), run, "lang string, part int, words binary, lengths binary, counts binary")


def _counts(runs: DataFrame, min_count: int) -> DataFrame:
    def run(batches):
        for _, lang, phrases, counts in _merged_groups(batches):
            often = np.flatnonzero(counts >= min_count)
            if len(often):
                found = phrases.take(pa.array(often)).cast(pa.binary()).cast(pa.string())
                words = pc.add(pc.count_substring(found, " "), 1).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(often), pa.string()), found, words, pa.array(counts[often])],
                                                 names=["lang", "phrase", "words", "f"])

    return map_arrow(_dealt(runs), run, "lang string, phrase string, words int, f long")


# ---- collocations ----------------------------------------------------------

def _whole(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _words(i: int, j: int) -> Column:
    """Words ``i`` to ``j`` (from 1) of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), i, j - i + 1), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first
    ``top`` phrases of two or three words.

    ``a`` counts the phrase (at least ``min_count``), ``l`` and ``r`` the two
    parts of the cut with the lowest ``score = floor(1000000 a a / (l r))``
    (ties: the earlier cut), in decimals of 38 digits, exact for counts up to
    10^16; ``n`` counts all word occurrences of the language.  A phrase that
    lies in a longer one with at least half of its count is left out.  Order:
    score and a descending, phrase in byte order.  Texts, nulls and repeated
    rows as in :func:`phrase_counts`; no candidates give no rows.
    """
    counts, totals = phrase_counts(docs, text, lang, min_count)
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    two, three = counts.where("words = 2"), counts.where("words = 3")
    ends = lambda df, last: df.select("lang", "phrase", F.col("f").alias("a"), _words(1, 1).alias("p1"), _words(last, last).alias("p9"))
    scored2 = (ends(two, 2).join(part("p1", "l"), ["lang", "p1"]).join(part("p9", "r"), ["lang", "p9"])
               .select("lang", "phrase", "a", "l", "r", _score("l", "r").alias("score")))
    # both cuts of three words
    wide = three.select("lang", "phrase", F.col("f").alias("a"), _words(1, 1).alias("p1"), _words(2, 3).alias("q23"),
                        _words(1, 2).alias("q12"), _words(3, 3).alias("p3"))
    for name, f in (("p1", "l1"), ("q23", "r1"), ("q12", "l2"), ("p3", "r2")):
        wide = wide.join(part(name, f), ["lang", name])
    s1, s2 = _score("l1", "r1"), _score("l2", "r2")
    scored3 = wide.select("lang", "phrase", "a", s1.alias("s1"), s2.alias("s2"), "l1", "r1", "l2", "r2").select(
        "lang", "phrase", "a", F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(F.col("s1") <= F.col("s2"), F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    # the largest count of a longer candidate around each phrase of two words
    around = (three.select("lang", "f", F.explode(F.array(_words(1, 2), _words(2, 3))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept2 = scored2.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_whole("longer") * 100 < _whole("a") * COVER)).drop("longer")
    every = kept2.unionByName(scored3)
    # ranked in salted groups first, so that no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = Window.partitionBy("lang", "_salt").orderBy(*order)
    some = every.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).drop("_r", "_salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(left: str, right: str) -> Column:
    # a part occurs at least as often as the whole, so a score is at most SCALE
    whole = lambda c: f"cast({c} as decimal(38,0))"
    return F.expr(f"{whole('a')} * {whole('a')} * {SCALE} div ({whole(left)} * {whole(right)})")
