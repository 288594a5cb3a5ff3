"""Phrase collocation mining by Toivonen's method: a sample proposes, full passes count, misses of the border call for more passes.

Phrases are runs of words inside a piece of text, per language. A sample of documents gives a set S of phrases that look frequent. A full pass
counts every phrase whose shorter runs all lie in S: that is S itself and its negative border, the phrases just outside it. A border phrase
that turns out frequent is a miss: it joins S and another pass counts what the larger S has let in. Whatever the sample held, all
frequent words are known after the first pass, all frequent pairs after the second and so on, so ``longest`` passes suffice and nothing is lost.

S reaches the tasks as a Bloom filter of fixed size, which is the bound of what is broadcast: a false hit only counts a phrase that need not be
counted. Counts are exact: words and phrases are told apart by their bytes, and hashes serve the filter alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tagloom.llm import words as W
from tagloom.session import materialize

U = np.uint64
BLANKS = b" \t"
ENDS = b".,;:!?\n\x0b\x0c\r"
BREAKS, PIECE_ENDS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[[*BLANKS, *ENDS]] = True
PIECE_ENDS[[*ENDS]] = True
GAP = np.zeros(256, bool)  # between the words of a phrase
GAP[0x20] = True
LONGEST = 4
BLOCK = 1 << 21  # bytes of text whose phrases are counted together in a task
FILTER_BITS = 26  # 2**26 bits are 8 MB
_CHUNK_WORDS = 1024
HASHED = U(0xFFFFFFFFFF000000)  # the 40 bits of a hash that filters and border counts look at: rows of short hashes pack better, and what shares one is told apart by its bytes
MERGED = 1 << 20  # counts of several blocks that a task adds up before they become rows
_COUNTED = "key string, h long, n long"  # a phrase by its bytes (language, line end, phrase: one short key keeps the rows of a shuffle small) or by its hash
SPELL, SPLIT, AGAIN, HASH = "spell", "split", "again", "hash"  # what a pass counts, and how


def _then(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return W.mix(hashes * U(0x9E3779B97F4A7C15) + word)


def _texts_hash(column: pa.Array) -> np.ndarray:
    data, offsets = W.utf8(column)
    return W.span_hash(W.running(data), offsets[:-1], offsets[1:])


def _phrase_hash(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hash that counting gives the same phrase of the same language."""
    data, offsets = W.utf8(phrases)
    found = W.words_of(data, offsets, False, GAP)
    out, at = _texts_hash(langs), found.first[:-1].copy()
    for _ in range(LONGEST):
        more = np.flatnonzero(at < found.first[1:])
        out[more] = _then(out[more], found.hashes[at[more]])
        at[more] += 1
    return out


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of two probes over phrase hashes. It travels compressed: few phrases leave most of it empty."""

    words: np.ndarray

    def __reduce__(self):
        return Filter.unpack, (pa.compress(self.words.tobytes(), "zstd", asbytes=True), len(self.words))

    @staticmethod
    def unpack(packed: bytes, size: int) -> Filter:
        return Filter(np.frombuffer(pa.decompress(packed, size * 8, "zstd", asbytes=True), U))

    @staticmethod
    def probes(hashes: np.ndarray, bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
        hashes = hashes & HASHED
        return hashes >> U(64 - bits), W.mix(hashes + U(1)) >> U(64 - bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.probes(hashes):
            out &= (self.words[place >> U(6)] >> (place & U(63))) & U(1) == 1
        return out


def _grown(phrases: DataFrame, held: Filter, shared: Broadcast) -> Filter | None:
    """``held`` (broadcast as ``shared``) and the rows ``lang, phrase`` or ``h`` it lacks; None if it lacks none. Spark merges the bits; the driver gets 8 MB at most."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.filter(batch.column("phrase").is_valid())
            hashes = _phrase_hash(spelled.column("lang"), spelled.column("phrase"))
            hashes = np.concatenate((hashes, batch.column("h").drop_null().to_numpy().view(U)))
            places = np.concatenate(Filter.probes(hashes[~shared.value.holds(hashes)]))
            yield pa.record_batch([pa.array((places >> U(6)).astype(np.int64)), pa.array((U(1) << (places & U(63))).view(np.int64))], ["word", "bits"])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        values = np.zeros(_CHUNK_WORDS, np.int64)
        values[table["word"].to_numpy() % _CHUNK_WORDS] = table["bits"].to_numpy()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([values.tobytes()], pa.binary())})

    merged = phrases.select("lang", "phrase", "h").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = merged.groupBy(F.floor(F.col("word") / _CHUNK_WORDS).alias("chunk")).applyInArrow(pack, "chunk long, packed binary").toArrow()
    out = held.words.copy()
    for chunk, values in zip(packed["chunk"].to_pylist(), packed["packed"].to_pylist()):
        out[chunk * _CHUNK_WORDS : (chunk + 1) * _CHUNK_WORDS] |= np.frombuffer(values, U)
    return Filter(out) if packed.num_rows else None


def _codes(values: pa.Array) -> np.ndarray:
    """A number from 0 for each distinct value."""
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class _Block:
    """Words of several texts: bytes and hash of each, its piece and text; ``langs`` has the language of each text."""

    spelled: pa.Array
    hashes: np.ndarray
    piece: np.ndarray
    owner: np.ndarray
    langs: pa.Array


def _block_of(batches: list[pa.RecordBatch]) -> _Block:
    """Words are found in a megabyte of text at a time; a text is never cut."""
    spelled, hashes, piece, owner, langs, pieces, texts = [], [], [], [], [], 0, 0
    for batch in batches:
        data, offsets = W.utf8(batch.column("text"))
        folded = W.FOLD[data]
        found = W.words_of(folded, offsets, False, BREAKS)
        own = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(PIECE_ENDS[data], out=ends[1:])
        lengths = np.zeros(len(found.hashes) + 1, np.int64)
        np.cumsum(found.ends - found.starts, out=lengths[1:])
        letters = pa.py_buffer(folded[~BREAKS[data]])
        spelled.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found.hashes), [None, pa.py_buffer(lengths), letters]))
        hashes.append(found.hashes)
        piece.append(ends[found.starts] + own + pieces)
        owner.append(own + texts)
        langs.append(batch.column("lang"))
        pieces, texts = pieces + int(ends[-1]) + batch.num_rows, texts + batch.num_rows
    return _Block(pa.concat_arrays(spelled), *map(np.concatenate, (hashes, piece, owner)), pa.concat_arrays(langs))


def _numbers(block: _Block, at: np.ndarray, k: int, word: np.ndarray | None) -> np.ndarray:
    """A number from 0 for each distinct phrase of a language among those of ``k`` words from the places ``at`` on; ``word`` has the numbers of all words, if known."""
    each = at[:, None] + np.arange(k)
    words = word[each] if word is not None else _codes(block.spelled.take(pa.array(each.reshape(-1)))).reshape(-1, k)
    code = _codes(block.langs)[block.owner[at]]
    for j in range(k):
        code = _codes(pa.array(code << 31 | words[:, j]))
    return code


def _let_in(block: _Block, now: Filter | None, before: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``LONGEST`` words: the places of the phrases ``now`` lets in, their hashes, which of them ``before`` lets in, which it holds as well, and which ``now`` holds.

    A phrase is let in if a filter holds both runs one word shorter and lets them in; words always are. No filter for ``now`` holds everything, none for ``before`` nothing.
    """
    total = len(block.hashes)
    hashes = _then(_texts_hash(block.langs)[block.owner], block.hashes)
    places, known = np.arange(total), np.full(total, before is not None)
    for k in range(1, LONGEST + 1):
        mine, old = hashes[places], np.zeros(len(places), bool)
        if before is not None:
            old[known] = before.holds(mine[known])
        held = old.copy()  # what ``before`` holds ``now`` holds as well
        held[~old] = True if now is None else now.holds(mine[~old])
        yield k, places, mine, known, old, held
        if k == LONGEST or total <= k:
            return
        inside, was = np.zeros(total, bool), np.zeros(total, bool)
        inside[places], was[places] = held, old
        places = np.flatnonzero(inside[:-k] & inside[1 : total - k + 1] & (block.piece[:-k] == block.piece[k:]))
        known = was[places] & was[places + 1]
        longer = np.zeros(total, U)
        longer[places] = _then(hashes[places], block.hashes[places + k])
        hashes = longer


def _count_block(block: _Block, now: Filter | None, before: Filter | None, how: str = SPELL) -> Iterator[pa.RecordBatch]:
    """Counts of a block's phrases that ``now`` lets in (all phrases without ``now``) and ``before`` does not, as ``how`` says: batches ``key, n`` by their bytes, or ``h`` with a hash of each occurrence.

    SPELL counts all by their bytes. HASH gives the hashes of those ``now`` does not hold. SPLIT does both, by bytes those ``now`` holds, and each language has a row of the empty phrase with all its words.
    AGAIN follows SPLIT: it counts what ``now`` lets in anew and what was in the border before and is held now. Only what is counted by bytes is numbered; the rest of the text is hashed.
    """
    total = len(block.hashes)
    if total == 0:
        return
    steps = before is None and how != HASH  # the numbers of phrases follow from those one word shorter
    lang = _codes(block.langs)[block.owner] if steps else None
    word = _codes(block.spelled) if steps else None
    code = lang
    if how == SPLIT:
        n = np.bincount(lang)
        keys = pc.binary_join_element_wise(block.langs.unique().take(pa.array(np.flatnonzero(n))), "", "\n")
        yield pa.record_batch([keys.cast(pa.string()), pa.array(n[n > 0].astype(np.int64))], ["key", "n"])
    for k, places, hashes, known, old, held in _let_in(block, now, before):
        if how in (SPLIT, HASH):
            yield pa.record_batch([pa.array((hashes[~known & ~held] & HASHED).view(np.int64))], ["h"])
        if how == HASH:
            continue
        fresh = places[held if how == SPLIT else ~known | (held & ~old) if how == AGAIN else ~known]
        if len(fresh) == 0:
            continue
        if steps:
            longer = np.zeros(total, np.int64)
            longer[fresh] = _codes(pa.array(code[fresh] << 31 | word[fresh + k - 1]))
            code = longer
            mine = code[fresh]
        else:
            if word is None and len(fresh) * k > total:
                word = _codes(block.spelled)
            mine = _numbers(block, fresh, k, word)
        n = np.bincount(mine)
        example = np.zeros(len(n), np.int64)
        example[mine[::-1]] = fresh[::-1]
        parts = [block.spelled.take(pa.array(example + j)) for j in range(k)]
        phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
        langs = block.langs.take(pa.array(block.owner[example])).cast(pa.large_binary())
        keys = pc.binary_join_element_wise(langs, phrases, pa.scalar(b"\n", pa.large_binary()))
        yield pa.record_batch([keys.cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64))], ["key", "n"])


def _merged(batches: list[pa.RecordBatch]) -> pa.Table:
    """``key, h, n`` of batches of one kind as ``_count_block`` gives them, each phrase once."""
    if batches[0].schema.names == ["h"]:
        ordered = np.sort(np.concatenate([b.column("h").to_numpy() for b in batches]))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
        return pa.table({"key": pa.nulls(len(first), pa.string()), "h": ordered[first], "n": np.diff(first, append=len(ordered))})
    summed = pa.Table.from_batches(batches).group_by("key", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"key": summed["key"], "h": pa.nulls(summed.num_rows, pa.int64()), "n": summed["n_sum"]})


def _counts(texts: DataFrame, least: int, now: Broadcast, before: Broadcast | None, how: str) -> DataFrame:
    """``lang, phrase, k, h, n`` of what a pass counts ``least`` times or more: ``h`` is null for phrases counted by their bytes, the others are null for those counted by hash.

    HASH counts the border alone, SPLIT the border by hash and the rest by bytes. Each filter is broadcast once, whatever the number of passes that use it.
    """
    filters = (now, before)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        held, size = [], 0
        for batch in W.slices(batches, "text"):
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield _block_of(held)
                held, size = [], 0
        if held:
            yield _block_of(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = (f and f.value for f in filters)
        kinds = {"key": [], "h": []}
        for block in blocks(batches):
            for batch in _count_block(block, now, before, how):
                kinds[batch.schema.names[0]].append(batch)
            for kind in kinds.values():
                if sum(b.num_rows for b in kind) >= MERGED:
                    yield from _merged(kind).to_batches(1 << 15)
                    kind.clear()
        for kind in kinds.values():
            if kind:
                yield from _merged(kind).to_batches(1 << 15)

    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("left(key, length(key) - length(phrase) - 1)")
    # the tasks have added up what they can, so rows are dealt first: Spark's partial sums would hold nearly every row once more
    found = texts.mapInArrow(count, _COUNTED).repartition("key", "h").groupBy("key", "h").agg(F.sum("n").alias("n")).withColumn("phrase", phrase)
    k = F.when(F.col("phrase") == "", 0).when(F.col("phrase").isNotNull(), F.size(F.split("phrase", " ")))
    return found.select(lang.alias("lang"), "phrase", k.alias("k"), "h", "n").filter((F.col("n") >= least) | (F.col("k") == 0))


def frequent_phrases(docs: DataFrame, least: int, one_in: int = 4) -> DataFrame:
    """Every phrase of 1 to 4 words that occurs ``least`` times or more in its language: lang, phrase, k (words), n (times). A row of each language with k 0 has all its words.

    A quarter of the documents (``one_in``), picked by a hash of id and text, is the sample, mined level by level with four fifths of the share as its threshold (two at least). Sample and
    threshold only decide how many passes follow. A null text is empty, a null language is ``und``; repeated rows count as often as they occur.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("h"))
    sample = texts.filter(F.pmod("h", F.lit(one_in)) == 0).select("lang", "text")
    texts = texts.select("lang", "text")
    looks = max(2, 4 * least // (5 * one_in))
    send = docs.sparkSession.sparkContext.broadcast
    held = Filter(np.zeros(1 << (FILTER_BITS - 6), U))
    now, before = send(held), None
    for _ in range(1, LONGEST):  # an empty filter lets in words alone, one with words pairs and so on
        grown = _grown(_counts(sample, looks, now, before, HASH), held, now)
        if grown is None:
            break
        held, now, before = grown, send(grown), now
    before, passes = None, []
    while True:
        passes.append(materialize(_counts(texts, least, now, before, (SPLIT, AGAIN, SPELL)[min(len(passes), 2)]), "phrases"))
        grown = _grown(passes[-1].filter(F.col("h").isNotNull() | F.col("k").between(1, LONGEST - 1)), held, now)
        if grown is None:
            break
        held, now, before = grown, send(grown), now
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found.filter(F.col("phrase").isNotNull()).drop("h")


def _join_words(words, start, count):
    return F.array_join(F.slice(words, start, count), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80, salts: int = 64) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score, in no order.

    ``score`` is ``floor(2000000 * a / (l + r))`` of the lowest-scoring cut. A phrase is dropped if a longer frequent phrase that holds it makes up ``inside_percent`` or more
    of its occurrences. Null and empty texts have no words; an empty table gives no rows; other columns are ignored, whatever their names.
    Very long texts take part whole; equal scores are ordered by ``a`` and the phrase's bytes.
    """
    big = "decimal(20,0)"
    counted = frequent_phrases(docs, least)
    totals = counted.filter("k = 0").select("lang", "n")
    parts = counted.filter(F.col("k").between(1, LONGEST - 1)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    whole = counted.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = whole.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    left = cuts.select("lang", "phrase", "a", "cut", _join_words("w", F.lit(1), F.col("cut")).alias("part"), F.lit(0).alias("side"))
    right = cuts.select("lang", "phrase", "a", "cut", _join_words("w", F.col("cut") + 1, F.size("w") - F.col("cut")).alias("part"), F.lit(1).alias("side"))
    sides = left.unionByName(right).join(parts, ["lang", "part"])
    both = sides.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"(CAST(2000000 AS {big}) * CAST(a AS {big})) div (CAST(l AS {big}) + CAST(r AS {big}))")
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("best"))

    runs = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    holders = whole.filter("k > 2").select("lang", F.col("a").alias("f"), F.explode(runs).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    inside = F.coalesce(F.col("f").cast(big) * 100 >= F.col("a").cast(big) * inside_percent, F.lit(False))
    kept = scored.join(holders, ["lang", "phrase"], "left").filter(~inside)
    kept = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
