"""Pages of keywords, links or tags instead of sentences: replicated phrase shingles over distinct hosts, joined with list density.

Phrases are shingles of one to three words. Evidence on a page is a list (short items between marks, no full stop), or a
phrase of two or three words that the page itself says again and again in ever other surroundings. A phrase with such evidence on enough distinct hosts
and in enough of all its occurrences is a list phrase, and every page's words that lie in list phrases count as stitched,
also where the page puts them into sentences; a sentence or line of which most is stitched counts as a whole. A page is
flagged when most of its words are links, tags, listed or stitched.

The texts are read twice, as arrays. The first reading counts the hosts of phrases with evidence; those on enough hosts are
candidates, single words only if they have evidence often enough, too. The second one counts the candidates' occurrences everywhere. So that no shingle of ordinary text is shuffled, a
Bloom filter of the candidates, of at most FILTER_BITS whatever their number, lets through what may be one; the exact join
comes after it, and the filter changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .page_words import Words, enumerated, shingles, words_of

WIDTHS = (1, 2, 3)
BATCH_BYTES = 1 << 20
FILTER_BITS, PROBES = 1 << 27, 4

_SEEN = pa.schema([("phrase", pa.int64()), ("host", pa.string()), ("n", pa.int64()), ("n_listed", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("phrase", pa.int64()), ("n", pa.int32()), ("n_listed", pa.int32()), ("places", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("against", pa.list_(pa.int32()))])
_SEEN_DDL = "phrase long, host string, n long, n_listed long"
_FOUND_DDL = "doc_id long, phrase long, n int, n_listed int, places array<long>, sizes array<int>, against array<int>"


def host_of(documents: DataFrame) -> Column:
    """What stands for a page's host: its ticker, else the letters its title starts with, else the page itself."""
    title = F.regexp_extract(F.lower(F.trim("title")), r"^(\p{L}+)", 1)
    return F.coalesce(F.nullif(F.lower(F.trim("ticker")), F.lit("")), F.nullif(title, F.lit("")), F.col("doc_id").cast("string"))


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, never less than one page."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(), dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _phrases(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(codes, places, with evidence, width) of each width."""
    for width in WIDTHS:
        code, at = shingles(words, width)
        listed = words.listed[at]
        yield code, at, listed | enumerated(words, code, at, width) if width > 1 else listed, width


def _first_reading(batches: Iterator[pa.RecordBatch], longest_item: float) -> Iterator[pa.RecordBatch]:
    """The hosts of phrases with evidence, and of every word (host null) how often it occurs and how often with evidence."""
    for part in _parts(batches, 1):
        words = words_of(part.column(1), longest_item)
        codes, pages = [], []
        for code, at, listed, width in _phrases(words):
            codes.append(code[listed])
            pages.append(words.page[at[listed]])
            if width == 1:
                own, back = np.unique(code, return_inverse=True)
                counts = [np.bincount(back, minlength=len(own)), np.bincount(back, listed, minlength=len(own)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.string()), *map(pa.array, counts)], schema=_SEEN)
        hosts = part.column(0).dictionary_encode()
        pairs = pa.table({"phrase": np.concatenate(codes), "host": hosts.indices.to_numpy()[np.concatenate(pages)]}).group_by(["phrase", "host"]).aggregate([])
        zero = pa.array(np.zeros(pairs.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays([pairs["phrase"].combine_chunks(), hosts.dictionary.take(pairs["host"].combine_chunks()), zero, zero], schema=_SEEN)


def _probes(code: np.ndarray, bits: int) -> np.ndarray:
    """The places of a code in a filter of `bits`, a power of two: a row for each probe."""
    low, high = code & 0x7FFFFFFF, (code >> 32) & 0x7FFFFFFF
    return np.array([(low + k * (high | 1)) & (bits - 1) for k in range(PROBES)])


def phrase_filter(candidates: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of candidates.phrase: 16 bits for each, FILTER_BITS (16 MB) at most, gathered as bitmaps of 4 KB."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << int(16 * candidates.count()).bit_length()))
    low, high = F.col("phrase").bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned("phrase", 32).bitwiseAND(0x7FFFFFFF)
    at = F.explode(F.array(*((low + k * high.bitwiseOR(F.lit(1).cast("long"))).bitwiseAND(bits - 1) for k in range(PROBES)))).alias("at")
    parts = candidates.select(at).groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS at most
        own = np.frombuffer(bytes(r.bitmap), np.uint8)
        start = (r.bucket - 1) * 4096
        out[start : start + 4096] |= own[: len(out) - start]
    return out, bits


def _second_reading(batches: Iterator[pa.RecordBatch], longest_item: float, bitmap: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, 1):
        words = words_of(part.column(1), longest_item)
        counts = words.code != 0  # a number is no word
        against = (words.link | words.listed) & counts
        n = part.num_rows
        ids = part.column(0).to_numpy()
        # Each page's segments: their words, and those already against the page.
        segment, first = np.unique(words.segment, return_index=True)
        of = np.searchsorted(segment, words.segment)
        offsets = np.r_[0, np.cumsum(np.bincount(words.page[first], minlength=n))].astype(np.int32)
        sizes, junk = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.bincount(of, x, minlength=len(segment)).astype(np.int32))) for x in (counts, against))
        inner = (of - offsets[words.page]).astype(np.int64) << 32 | words.place  # a word's segment in its page and its place
        none = pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), none, none, pa.nulls(n, _FOUND.field("places").type), sizes, junk], schema=_FOUND)
        for code, at, listed, width in _phrases(words):
            probes = _probes(code, bits)
            hit = np.flatnonzero(np.all((bitmap[probes >> 3] >> (probes & 7).astype(np.uint8)) & 1, axis=0))
            if not len(hit):
                continue
            order = hit[np.lexsort((at[hit], code[hit], words.page[at[hit]]))]
            own, page, place = code[order], words.page[at[order]], at[order]
            fresh = np.r_[True, (np.diff(own) != 0) | (np.diff(page) != 0)]
            run = np.cumsum(fresh) - 1
            spread = place[:, None] + np.arange(width)  # the words a phrase covers, without those already against the page
            open_words = (counts & ~against)[spread]
            offsets = np.r_[0, np.cumsum(np.bincount(run, open_words.sum(1)))].astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(inner[spread][open_words]))
            zero = pa.nulls(len(places), _FOUND.field("sizes").type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[page[fresh]]), pa.array(own[fresh]), pa.array(np.bincount(run), pa.int32()), pa.array(np.bincount(run, listed[order]).astype(np.int32)), places, zero, zero], schema=_FOUND
            )


def score_pages(documents: DataFrame, least_hosts: int = 3, list_rate: float = 0.3, word_rate: float = 0.5, longest_item: float = 4.0) -> DataFrame:
    """(doc_id, n_words, n_against, share_against) for each text with anything but white space; null and blank texts have no row.

    documents: doc_id unique, text, title, ticker; other columns are ignored. Whole texts are read. A phrase counts as a list
    phrase with evidence on at least least_hosts hosts and in at least list_rate (a single word: word_rate) of its occurrences; a list has at most
    longest_item words to an item. Numbers are no words; a text without any word counts as all against.
    """
    texts = documents.filter(F.col("text").rlike(r"\S"))
    seen = texts.select(host_of(documents).alias("host"), "text").mapInArrow(lambda batches: _first_reading(batches, longest_item), _SEEN_DDL)
    # Two steps, so that a phrase of very many pages is combined before its hosts are counted.
    per_host = seen.groupBy("phrase", "host").agg(F.sum("n").alias("n"), F.sum("n_listed").alias("n_listed"))
    per_phrase = per_host.groupBy("phrase").agg(F.count("host").alias("hosts"), F.sum("n").alias("n"), F.sum("n_listed").alias("n_listed"))
    candidates = stored(per_phrase.filter((F.col("hosts") >= least_hosts) & (F.col("n_listed") >= word_rate * F.col("n"))).select("phrase"))
    bitmap, bits = phrase_filter(candidates)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)  # FILTER_BITS at most
    rows = stored(texts.select("doc_id", "text").mapInArrow(lambda batches: _second_reading(batches, longest_item, shared.value, bits), _FOUND_DDL))
    phrases = rows.filter("phrase is not null")
    counts = phrases.groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("n_listed").alias("n_listed")).filter(F.col("n_listed") >= list_rate * F.col("n"))
    list_phrases = counts.join(candidates, "phrase", "left_semi").select("phrase")
    # One shuffle by page for the three steps: a page's words, its segments, the page.
    covered = phrases.filter(F.size("places") > 0).join(list_phrases, "phrase").select("doc_id", F.explode("places").alias("place")).repartition("doc_id").distinct()
    of_segment = covered.groupBy("doc_id", F.shiftright("place", 32).cast("int").alias("segment")).agg(F.count("*").cast("int").alias("n"))
    stitched = of_segment.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("segment", "n"))).alias("stitched"))
    pages = rows.filter("phrase is null").select("doc_id", F.arrays_zip("sizes", "against").alias("segments"))

    def counted(x: Column, i: Column) -> Column:
        own = x["against"] + F.coalesce(F.try_element_at("stitched", i), F.lit(0))
        return F.when(2 * own > x["sizes"], x["sizes"]).otherwise(own)

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    n_words, against = total(F.transform("segments", lambda x: x["sizes"])), total(F.transform("segments", counted))
    scored = pages.join(stitched, "doc_id", "left").select("doc_id", n_words.alias("n_words"), against.alias("n_against"))
    return scored.withColumn("share_against", F.coalesce(F.try_divide("n_against", "n_words"), F.lit(1.0)))


def pages_without_sentences(documents: DataFrame, most: float = 0.5) -> DataFrame:
    """The scored pages with more than `most` of their words against them."""
    return score_pages(documents).filter(F.col("share_against") > most)
