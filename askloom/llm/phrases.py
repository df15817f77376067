"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

A stripe belongs to a prefix of up to three words and counts, word by word, what comes next; the
empty prefix's counts the words themselves. Merged elementwise over all texts, one table of stripes
has all that phrases are judged by: an entry is the count of a phrase (prefix and word), a stripe's
total that of its prefix, and its largest entry says whether a longer phrase subsumes the prefix.

Nearly all sequences of two or more words are rare, and a phrase cannot be frequent if the bucket
of its hash is not. So stripes are made in two passes. The first counts hashes of 48 bits: a block
of texts sends its hashes, each once with a count, sorted and cut by range, and every range finds
the hashes that reach the least count over all blocks and tells each block which of its own these
are. In the second pass a block makes stripes with entries for those only, and all else as one
entry without a word. Hashes that collide let more entries through, and lose none: stripes hold
the words themselves, so the counts are exact.

A block gets its own list back, not everyone's, so nothing is broadcast and a task holds no more
than its block. Words of one block are numbered, and counted as arrays; phrases are text only in Arrow,
and come out some thousand at a time, however many of a block's are frequent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Staging, written
from .memory import lean, small_batches

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
UNKNOWN = "und"
SCORE_UNITS = 2_000_000
SUBSUMED_PERCENT = 80

BLOCK_BYTES = 8 * 1024 * 1024  # of texts that are counted together
CHUNK_BYTES = 256 * 1024  # of texts in a row; a longer piece is a row of its own
RANGE_WORDS = 500_000  # words of all texts for each range of hashes
HASH_BITS = 48
BATCH_BYTES = 1024 * 1024  # of rows that come from Python together
BATCH_ROWS = 16 * 1024  # of stripes

#: A-Z in lower case, tabs as spaces, and all that ends a piece as a newline.
_FOLDED = bytes(
    10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))  # odd constants

_CHUNKS = "block long, lang string, data binary, n_words long"
_MESSAGES = "part long, block long, data binary"
_LISTS = "block long, data binary"
_ENTRIES = "lang string, prefix string, word string, n long"


# -- Blocks of text -------------------------------------------------------------------


def _pieces(data: bytes, at_most: int) -> Iterator[bytes]:
    """``data`` cut at ends of pieces into parts of ``at_most`` bytes, or one piece if that is longer."""
    start = 0
    while len(data) - start > at_most:
        cut = data.rfind(b"\n", start, start + at_most) + 1 or data.find(b"\n", start + at_most) + 1
        if not cut:
            break
        yield data[start:cut]
        start = cut
    if start < len(data):
        yield data[start:]


def _word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded text, and the number of each word's piece."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = (codes != 32) & (codes != 10)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    pieces = np.searchsorted(np.flatnonzero(codes == 10), starts)
    return starts, ends, pieces


def _chunks(block_bytes: int, chunk_bytes: int):
    """Texts (lang, text) folded and gathered by language into rows, and these into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, block, held = TaskContext.get().partitionId() << 32, 0, 0
        open_chunks: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def row(lang: str) -> pa.RecordBatch:
            data = b"".join(open_chunks.pop(lang))
            sizes.pop(lang)
            n = len(_word_bounds(data)[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([base + block], pa.int64()), pa.array([lang]), pa.array([data], pa.binary()), pa.array([n], pa.int64())],
                ["block", "lang", "data", "n_words"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                name = lang.as_py()
                folded = text.as_buffer().to_pybytes().translate(_FOLDED) + b"\n"
                for data in _pieces(folded, chunk_bytes):
                    if sizes.get(name, 0) + len(data) > chunk_bytes and name in sizes:
                        yield row(name)
                    open_chunks.setdefault(name, []).append(data)
                    sizes[name] = sizes.get(name, 0) + len(data)
                    held += len(data)
                    if held > block_bytes:
                        for other in list(open_chunks):
                            yield row(other)
                        block, held = block + 1, 0
        for other in list(open_chunks):
            yield row(other)

    return run


class _Words:
    """The words of one row, numbered, with the hashes of the sequences they begin."""

    def __init__(self, lang: str, data: bytes) -> None:
        starts, ends, self.pieces = _word_bounds(data)
        codes = np.frombuffer(data, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        letters = codes[(codes != 32) & (codes != 10)]
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())]
        ).dictionary_encode()
        self.ids = column.indices.to_numpy()
        self.words = column.dictionary
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = [xxhash.xxh3_64_intdigest(w.as_buffer(), seed) for w in self.words]
        self.first = np.array(hashes, np.uint64)[self.ids] if len(self.ids) else np.empty(0, np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """For each place whether ``n`` words of one piece begin there."""
        if len(self.pieces) < n:
            return np.zeros(0, bool)
        return self.pieces[: len(self.pieces) - n + 1] == self.pieces[n - 1 :]

    def hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        """For n from 1 on: the hash, of 48 bits, of the n words from each place on."""
        state = self.first.copy()
        for n in range(1, MAX_WORDS + 1):
            if n > 1:
                state = (state[:-1] * _MIX[0] + self.first[n - 1 :]) if len(state) else state
                state ^= state >> np.uint64(29)
            mixed = (state + np.uint64(n)) * _MIX[1]
            mixed ^= mixed >> np.uint64(31)
            yield n, (mixed * _MIX[0]) >> np.uint64(64 - HASH_BITS)


# -- First pass: which hashes are frequent --------------------------------------------


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, the first column ascending, byte plane by byte plane and compressed."""
    first = np.diff(columns[0], prepend=np.uint64(0)).astype("<u8")
    planes = [first.view(np.uint8).reshape(-1, 8).T]
    planes += [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns[1:]]
    head = len(first).to_bytes(8, "little")
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(data: bytes, more: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    first = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    out = [np.cumsum(first, dtype=np.uint64)]
    for i in range(more):
        plane = raw[8 * n + 4 * n * i : 8 * n + 4 * n * (i + 1)].reshape(4, n)
        out.append(np.ascontiguousarray(plane.T).view("<u4").ravel())
    return out


def _messages(part_bits: int):
    """For each block and range of hashes: the hashes there, each once with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for block, lang, data in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "data"))):
                if block != now and found:
                    yield from _message(now, found, part_bits)
                    found = []
                now, words = block, _Words(lang, data)
                for n, hashes in words.hashes():
                    found.append(hashes[words.whole(n)])
        if found:
            yield from _message(now, found, part_bits)

    return run


def _message(block: int, found: list[np.ndarray], part_bits: int) -> Iterator[pa.RecordBatch]:
    """The messages of one block; ``found`` is empty afterwards."""
    every = np.concatenate(found)
    found.clear()
    every.sort()
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    hashes, counts = every[first], np.diff(first, append=len(every))
    del every, first
    parts = (hashes >> np.uint64(HASH_BITS - part_bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(parts, prepend=-1))
    ends, numbers = [*begin[1:], len(parts)], parts[begin]
    del parts
    rows = ((part, block, _packed(hashes[a:b], np.minimum(counts[a:b], 0xFFFFFFFF))) for part, a, b in zip(numbers, begin, ends))
    yield from _blobs(rows, ["part", "block", "data"])


def _blobs(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers and, last, bytes, ``BATCH_BYTES`` at a time."""
    some, held = [], 0

    def batch() -> pa.RecordBatch:
        *numbers, data = zip(*some)
        return pa.RecordBatch.from_arrays([*[pa.array(n, pa.int64()) for n in numbers], pa.array(data, pa.binary())], names)

    for row in rows:
        some.append(row)
        held += len(row[-1])
        if held > BATCH_BYTES:
            yield batch()
            some, held = [], 0
    if some:
        yield batch()


def _frequent(least: int):
    """From messages sorted by range: for each block its hashes that are frequent over all."""

    def answer(blocks: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [_unpacked(d, 1) for d in data]
        hashes, back = np.unique(np.concatenate([c[0] for c in columns]), return_inverse=True)
        totals = np.bincount(back, weights=np.concatenate([c[1] for c in columns]), minlength=len(hashes))
        enough, at, out = (totals >= least)[back], 0, []
        for own, _ in columns:
            out.append(own[enough[at : at + len(own)]])
            at += len(own)
        yield from _blobs(((b, _packed(own)) for b, own in zip(blocks, out) if len(own)), ["block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, data = None, [], []
        for batch in batches:
            for part, block, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and data:
                    yield from answer(blocks, data)
                    blocks, data = [], []
                now = part
                blocks.append(block)
                data.append(packed)
        if data:
            yield from answer(blocks, data)

    return run


# -- Second pass: stripes -------------------------------------------------------------


def _is_in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def stripes_of(words: _Words, listed: np.ndarray) -> Iterator[tuple[list[str], list[str | None], np.ndarray]]:
    """Prefixes, next words and counts of one row's stripes, as lists."""
    for prefixes, nexts, counts in _stripes(words, listed):
        yield prefixes.to_pylist(), nexts.to_pylist(), counts


def _stripes(words: _Words, listed: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Prefixes, next words and counts of one row's stripes, ``BATCH_ROWS`` at a time.

    Entries for sequences whose hash is listed; a prefix's other occurrences are counted under None.
    A prefix that is not listed itself has no listed extension, and no stripe, but for the empty one.
    """
    size = len(words.ids)
    prefix = np.zeros(size, np.int64)  # number of the prefix that begins at a place, -1 for none
    names, texts = pa.array([""], pa.large_string()), words.words.cast(pa.large_string())
    for n, hashes in words.hashes():
        width = len(texts)
        here = words.whole(n) & _is_in(hashes, listed)
        here &= prefix[: len(here)] >= 0
        places = np.flatnonzero(here)
        pairs = prefix[places] * width + words.ids[places + n - 1]
        seen, back, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        heads, nexts = (seen // width, seen % width) if width else (seen, seen)
        del pairs, seen
        for a in range(0, len(heads), BATCH_ROWS):
            b = a + BATCH_ROWS
            yield names.take(pa.array(heads[a:b])).cast(pa.string()), texts.take(pa.array(nexts[a:b])).cast(pa.string()), counts[a:b]
        others = np.bincount(prefix[prefix >= 0], minlength=len(names))
        others -= np.bincount(heads, weights=counts, minlength=len(names)).astype(others.dtype)
        rest = np.flatnonzero(others)
        for a in range(0, len(rest), BATCH_ROWS):
            some = rest[a : a + BATCH_ROWS]
            yield names.take(pa.array(some)).cast(pa.string()), pa.nulls(len(some), pa.string()), others[some]
        if n == MAX_WORDS:
            return
        after = texts.take(pa.array(nexts))
        names = after if n == 1 else pc.binary_join_element_wise(names.take(pa.array(heads)), after, pa.scalar(" ", pa.large_string()))
        prefix = np.full(size, -1, np.int64)
        prefix[places] = back


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of rows sorted by block, each block's lists of hashes first."""
    now, lists, listed, held = None, [], np.empty(0, np.uint64), []

    def counted(lang: str) -> Iterator[pa.RecordBatch]:
        words = _Words(lang, b"".join(held))
        held.clear()
        for prefixes, nexts, counts in _stripes(words, listed):
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang), len(prefixes)), prefixes, nexts, pa.array(counts, pa.int64())],
                ["lang", "prefix", "word", "n"],
            )

    for batch in batches:
        for block, lang, data in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "data"))):
            if (block, lang) != now:
                if held:
                    yield from counted(now[1])
                if now is None or now[0] != block:
                    lists, listed = [], np.empty(0, np.uint64)
                elif lists:
                    listed, lists = np.sort(np.concatenate(lists)), []
                now = (block, lang)
            if lang is None:
                lists.append(_unpacked(data, 0)[0])
            else:
                held.append(data)
    if held:
        yield from counted(now[1])


def stripes(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    block_bytes: int = BLOCK_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """Merged stripes (lang, prefix, word, n), prefixes of up to three words joined by spaces.

    Every phrase of up to four words with ``min_count`` occurrences is an entry with its exact
    count, and every such phrase of up to three words a prefix, whose entries, with the one
    whose word is null, add up to its count. A few rarer ones are there too, as exact.
    The caller removes the folder that the result lies in.
    """
    with Staging(docs.sparkSession, "phrases") as stage, small_batches(docs.sparkSession):
        lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
        texts = docs.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        path = stage.path("chunks")
        texts.mapInArrow(lean(_chunks(block_bytes, chunk_bytes)), _CHUNKS).write.option("compression", "zstd").parquet(path)
        chunks = docs.sparkSession.read.schema(_CHUNKS).parquet(path)
        total = chunks.agg(F.sum("n_words").alias("n")).first()["n"] or 0
        part_bits = (total // range_words).bit_length()  # ranges are powers of two, so that none is searched for
        messages = chunks.select("block", "lang", "data").mapInArrow(lean(_messages(part_bits)), _MESSAGES)
        lists = stage.write(
            messages.repartition(1 << max(0, part_bits - 2), "part").sortWithinPartitions("part").mapInArrow(lean(_frequent(min_count)), _LISTS),
            "lists",
        )
        rows = chunks.select("block", "lang", "data").unionByName(lists.withColumn("lang", F.lit(None).cast("string")))
        entries = (
            rows.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("lang")).mapInArrow(lean(_entries), _ENTRIES)
        )
        merged = entries.groupBy("lang", "prefix", "word").agg(F.sum("n").alias("n"))
        return written(merged, "stripes")


# -- Phrases --------------------------------------------------------------------------


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def collocations(found: DataFrame, stage: Staging, min_count: int = MIN_COUNT) -> DataFrame:
    """Phrases of two to four words (lang, phrase, a, l, r, n, score) from merged stripes.

    A phrase is left out if one that is longer by a word at either end, which need not stay itself, has
    80 % of its occurrences: any longer one that has them holds one of these.
    """
    named = F.when(F.col("word").isNotNull(), F.col("n"))
    totals = stage.write(found.groupBy("lang", "prefix").agg(F.sum("n").alias("f"), F.max(named).alias("after")), "totals")
    phrase = F.concat_ws(" ", "prefix", "word")
    entries = found.where((F.col("word").isNotNull()) & (F.col("prefix") != "") & (F.col("n") >= min_count))
    phrases = stage.write(entries.select("lang", "prefix", phrase.alias("phrase"), F.col("n").alias("a")), "phrases")

    # the largest phrase that ends with this one, and the largest that begins with it
    before = phrases.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a")
    before = before.groupBy("lang", "phrase").agg(F.max("a").alias("before"))
    after = totals.select("lang", F.col("prefix").alias("phrase"), "after")
    longest = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)))
    # a longer phrase must be a candidate itself
    longest = F.when(longest >= min_count, longest).otherwise(0)
    subsumed = _exact(longest) * 100 >= _exact(F.col("a")) * SUBSUMED_PERCENT
    alone = phrases.join(before, ["lang", "phrase"], "left").join(after, ["lang", "phrase"], "left").where(~subsumed)

    # every cut, the counts of both parts, and the lowest score of a phrase
    words = F.split("phrase", " ")
    cuts = alone.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select(
        "*",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " ").alias("right"),
    )
    counted = (
        cuts.join(totals.select("lang", F.col("prefix").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(totals.select("lang", F.col("prefix").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    )
    score = F.expr(f"CAST(a AS DECIMAL(38, 0)) * {SCORE_UNITS} DIV (CAST(l AS DECIMAL(38, 0)) + r)")
    lowest = counted.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    sizes = totals.where("prefix = ''").select("lang", F.col("f").alias("n"))
    return lowest.join(sizes, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def phrase_table(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, min_count: int = MIN_COUNT, **sizes: int
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ``. , ; : ! ?`` and ends of lines into pieces, and these at spaces and tabs into
    words; A-Z count as lower case. Null texts are empty, a null language is ``und``. Ties
    of score and count go by the phrase's bytes. Equal rows count as often as they occur; very long texts
    are cut between pieces. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    found = stripes(docs, text_col, lang_col, min_count, **sizes)
    with Staging(docs.sparkSession, "collocations") as stage:
        phrases = stage.write(collocations(found, stage, min_count), "scored")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # the best of each share of a language, then the best of these: no language is one task
        share = F.pmod(F.xxhash64("phrase"), F.lit(64))
        best = phrases.withColumn("share", share).withColumn("no", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order)))
        best = stage.write(best.where(F.col("no") <= top).drop("no", "share"), "best")
        rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
        return written(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-table")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations."""
    return phrase_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), split AS (
  SELECT piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 30
), inner_parts AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS j) WHERE j < k)
  GROUP BY ALL
), alone AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < 80 * f
), cuts AS (
  SELECT a.lang, a.phrase, a.f AS a, c AS cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM alone) a
    JOIN grams x ON x.lang = a.lang AND x.phrase = array_to_string(w[1:c], ' ')
    JOIN grams y ON y.lang = a.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest JOIN sizes USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
