"""Evaluation texts leaking into training text.

Method: a positional inverted index. The terms are runs of three normalised words of an item;
one pass over the corpus gives their postings (document, term, position) together with the
stretches of words round them. The rarest terms of an item are its anchors: all its terms but
the few commonest, as few as no case can do without. An anchor's posting makes a candidate; a
candidate's lists of postings, shifted by the item's positions, are intersected, and an exact
alignment of the words of the item with the stretches follows for those with enough entries
of about one shift.

A document is a case if it holds at least half of the item's own words in its order, in one
or two pieces, or a run of at least 20 of them; replaced words break no piece as long as three
in four of its words are equal (17 in 20 of a run), and equal words count. A piece has at least
three equal words in a row, and no more than two other words between equal ones. Sentences that
several items have are not an item's own words.

Every case is a candidate, by counting. A piece of E equal words with g words between them has
at most g + 1 unbroken parts and g <= E / 3, so at least E / 3 - 2 of its terms stand unbroken
and one does by definition; of a run of 20, g <= 3 / 17 E, so 11 do. Their shifts differ by g at
most. ``least_terms`` and ``least_in_shift`` say what follows for an item of n own words. An
item loses as many anchors as it can lose terms, the commonest first.

Items are taken in blocks of about BLOCK_WORDS own words, however many there are, so what tasks
and driver hold of them (the distinct words and terms of one block) is bounded; items and
documents stay tables. An item of any length lies in one block.

Defined results: null, empty and blank texts and items match nothing; of repeated items with one
id the greatest text counts; documents may repeat. Whole texts are indexed.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.text import map_rows
from codeloom.plans.scratch import Scratch
from codeloom.sources.tables import table

SHINGLE = 3
RUN_WORDS = 20
SHARE = 0.5
BLOCK_WORDS = 2_000_000
MAX_GAP = 2
DENSITY, RUN_DENSITY = 0.75, 0.85
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕкмтнвԁԛԝһӏАВЕКМНОРСТХУІЈЅαοеνρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijskmthbdqwhlABEKMHOPCTXYIJSaoevptuikABEZHIKMNOPTYX")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿͏؜ᅟᅠ឴឵᠋-᠎]")
_ESCAPES = re.compile(r"\\(?:u\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2})|([nrtbfv])|([\"'\\/`*_{}\[\]()#+.!|<>~-]))")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n[\s>*#/|]*(?=[^\W\d_])")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.S)
_WORDS = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if code:
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else " "
    return " " if m.group(3) else m.group(4)


def _unquote(m: re.Match) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, escaping and forms of characters."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPES.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "%" in text:
        text = _PERCENT.sub(_unquote, text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text).translate(LOOKALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)
        text = text.replace("’", "'").replace("ʼ", "'")
    text = text.replace("'", "").casefold()
    return _WORDS.findall(text.replace("_", " ") if "__" in text or "*_" in text else text.replace("_", ""))


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(item_id: int, text: str) -> Iterator[tuple]:
    """(item_id, the item's words as one string, place of the sentence, its words) of every sentence."""
    found = [s for s in map(words, _SENTENCE.split(text)) if s]
    whole = "\n".join(map(" ".join, found))
    for k, s in enumerate(found):
        yield item_id, whole, k, s


def own_words(items: DataFrame) -> DataFrame:
    """item_id and the words of every item without sentences that several items have."""
    texts = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    arrow = pa.schema([("item_id", pa.int64()), ("whole", pa.string()), ("place", pa.int32()), ("words", pa.list_(pa.string()))])
    parts = map_rows(texts, sentences, "item_id long, whole string, place int, words array<string>", arrow)
    holders = parts.groupBy("words").agg(F.collect_set(F.struct("item_id", "place")).alias("at"), F.min("whole").alias("first"), F.max("whole").alias("last"))
    single = holders.where("first = last").select("words", F.explode("at").alias("at"))
    return single.groupBy("at.item_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at.place", "words"))), lambda x: x["words"])).alias("words"))


def least_terms(n: int) -> int:
    """How many terms at least an item of n own words shares with a document that holds half of it."""
    return max(1, -(-n // 6) - 4)


def least_in_shift(n: int) -> int:
    """How many of them at least are of about one shift: those of the longer of two pieces."""
    return max(1, -(-n // 12) - 2)


#: Terms of one shift in a run of RUN_WORDS.
RUN_TERMS = 11


def coded_terms(ids: np.ndarray, base: int) -> np.ndarray:
    """A number for every three words in a row, unlike for unlike words; 0 is no word of an item."""
    return (ids[:-2] * base + ids[1:-1]) * base + ids[2:] if len(ids) >= SHINGLE else np.zeros(0, np.int64)


def stretches(ids: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of the parts of a text round terms at places ``hits``, cut where more than MAX_GAP words in a row are in no item."""
    known = np.flatnonzero(ids)
    cuts = np.flatnonzero(np.diff(known) > MAX_GAP + 1)
    firsts, lasts = known[np.append(0, cuts + 1)], known[np.append(cuts, len(known) - 1)]
    for k in np.unique(np.searchsorted(firsts, hits, "right") - 1):
        yield int(firsts[k]), int(lasts[k])


def index(documents: DataFrame, codes: dict[str, int], vocabulary: np.ndarray) -> DataFrame:
    """doc_id, begin, ids, positions, terms: the parts of documents round the items' terms, with their postings."""
    spark, base = documents.sparkSession, len(codes) + 1
    shared = spark.sparkContext.broadcast((codes, vocabulary))

    def run(doc_id, text) -> Iterator[tuple]:
        codes, vocabulary = shared.value
        found = words(text)
        ids = np.fromiter(map(codes.get, found, repeat(0)), np.int64, len(found))
        terms = coded_terms(ids, base)
        at = np.searchsorted(vocabulary, terms)
        hits = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms)
        if len(hits):
            for first, last in stretches(ids, hits):
                own = hits[(hits >= first) & (hits <= last)]
                yield doc_id, first, ids[first : last + 1], own, terms[own]

    arrow = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("ids", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64()))])
    return map_rows(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), run, "doc_id long, begin int, ids array<int>, positions array<int>, terms array<long>", arrow)


def pieces(item: list, document: list) -> list[list[tuple[int, int, int]]]:
    """Pieces of an item in a document, in the order of both: each a list of (first item word, first document word, equal words).

    Equal stretches with few other words between them, on both sides, belong to one piece.
    """
    out: list[list[tuple[int, int, int]]] = []
    item_end = document_end = -MAX_GAP - 1
    for i, d, n in SequenceMatcher(None, item, document, autojunk=False).get_matching_blocks():
        if not n:
            continue
        if out and i - item_end <= MAX_GAP and d - document_end <= MAX_GAP:
            out[-1].append((i, d, n))
        else:
            out.append([(i, d, n)])
        item_end, document_end = i + n, d + n
    return [p for p in out if max(n for _, _, n in p) >= SHINGLE]


def most_equal(piece: list[tuple[int, int, int]], density: float) -> int:
    """The most equal words of a part of a piece, with three in a row, in which at least ``density`` of the words are equal."""
    best = 0
    for a in range(len(piece)):
        equal = longest = others = 0
        for k, (i, d, n) in enumerate(piece[a:], a):
            if k > a:
                last_i, last_d, last_n = piece[k - 1]
                others += max(i - last_i - last_n, d - last_d - last_n)
            equal, longest = equal + n, max(longest, n)
            if equal > best and longest >= SHINGLE and equal >= density * (equal + others):
                best = equal
    return best


def leaked(item: list, document: list) -> tuple[int, int]:
    """(most equal words in one run, most in two pieces) of an item."""
    found = pieces(item, document)
    parts = sorted((most_equal(p, DENSITY) for p in found), reverse=True)
    return max((most_equal(p, RUN_DENSITY) for p in found), default=0), sum(parts[:2])


def is_case(run: int, held: int, own: int) -> bool:
    return run >= RUN_WORDS or (own > 0 and held >= SHARE * own)


_CASES = "doc_id long, item_id long, run_words int, held_words int, own_words int"


def leaks(documents: DataFrame, items: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, run_words, held_words, own_words of every case."""
    own = scratch.spool(own_words(items).withColumn("n", F.size("words")))
    n_blocks = -(-(own.agg(F.sum("n")).first()[0] or 0) // block_words)
    found = documents.sparkSession.createDataFrame([], _CASES)
    for block in range(n_blocks):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else own
        found = found.unionByName(_block_leaks(documents, part, scratch))
    return found


def common_words(item: list[int], document: list[int]) -> int:
    """The length of the longest sequence of words that both have in order, by bits of a number."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = free = (1 << len(item)) - 1
    for w in document:
        at = places.get(w)
        if at:
            hit = free & at
            free = (free + hit | free - hit) & full
    return len(item) - free.bit_count()


class Lists:
    """The terms of a block of items with the items and places that hold them, in order of terms."""

    def __init__(self, items: dict[int, np.ndarray], base: int) -> None:
        self.ids = np.fromiter(items, np.int64, len(items))
        self.items = list(items.values())
        self.sizes = np.array([len(w) for w in self.items], np.int64)
        terms = [coded_terms(w.astype(np.int64), base) for w in self.items]
        all_terms = np.concatenate([np.zeros(0, np.int64), *terms])
        order = np.argsort(all_terms, kind="stable")
        self.terms = all_terms[order]
        self.holder = np.repeat(np.arange(len(terms)), [len(t) for t in terms])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(t)) for t in terms)])[order]

    def phrases(self, terms: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, most of its places at about one shift, all its places) for the items among a document's postings."""
        first, last = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        n = last - first
        at = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        holder, place = self.holder[at], self.place[at]
        shift = (np.repeat(positions, n) - place) // np.maximum(16, -(-self.sizes[holder] // 3))
        if not len(shift):
            return
        low, places = shift.min() - 1, int(place.max()) + 1
        span = int(shift.max() - low) + 1
        # A shift and its neighbour together: each posting counts for its own shift and the one below.
        both = np.unique(np.concatenate([(holder * span + shift - low - k) * places + place for k in (0, 1)])) // places
        groups, counts = np.unique(both, return_counts=True)
        owners = groups // span
        starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        every = np.unique(np.unique(holder * places + place) // places, return_counts=True)[1]
        yield from zip(owners[starts].tolist(), np.maximum.reduceat(counts, starts).tolist(), every.tolist())


def judge(item: list[int], most: int, every: int, document: list[int]) -> tuple[int, int] | None:
    """What ``leaked`` says of a case; None for others, most of which their terms and common words rule out."""
    n = len(item)
    if most < RUN_TERMS and (most < least_in_shift(n) or every < least_terms(n) or common_words(item, document) < SHARE * n):
        return None
    found = leaked(item, document)
    return found if is_case(*found, n) else None


def _block_leaks(documents: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """The cases of a block of items. What is collected and shared is bounded by BLOCK_WORDS: its distinct words, and its words and terms as numbers."""
    spark = documents.sparkSession
    distinct = own.select(F.explode("words").alias("word")).distinct().orderBy("word").toArrow()["word"].to_pylist()
    codes = {w: k for k, w in enumerate(distinct, 1)}
    base = len(codes) + 1

    def coded(item_id, item) -> Iterator[tuple]:
        ids = np.fromiter(map(codes.__getitem__, item), np.int64, len(item))
        yield item_id, ids, coded_terms(ids, base)

    arrow = pa.schema([("item_id", pa.int64()), ("item", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64()))])
    items = scratch.spool(map_rows(own.select("item_id", "words"), coded, "item_id long, item array<int>, terms array<long>", arrow))
    held = items.select("item_id", "item").toArrow()
    lists = Lists({i.as_py(): w.values.to_numpy() for i, w in zip(held["item_id"], held["item"])}, base)
    vocabulary = np.unique(lists.terms)
    if not len(vocabulary):
        return spark.createDataFrame([], _CASES)
    texts = scratch.spool(index(documents, codes, vocabulary))
    postings = texts.select("doc_id", F.explode("terms").alias("term")).distinct()
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    item_terms = items.select("item_id", F.size("item").alias("n"), F.posexplode("terms").alias("place", "term"))
    ranked = item_terms.join(frequency, "term").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("documents"), "place")))
    least = F.least(F.lit(RUN_TERMS), F.greatest(F.lit(1), F.ceil(F.col("n") / 6) - 4))
    anchors = ranked.where(F.col("rank") >= least).select("term", "item_id").distinct()
    candidates = postings.join(anchors, "term").groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    whole = texts.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("begin", "ids", "positions", "terms"))).alias("parts"))
    shared = spark.sparkContext.broadcast(lists)

    def cases(doc_id, ids, parts) -> Iterator[tuple]:
        lists, asked, document = shared.value, set(ids), []
        for part in parts:
            document += part["ids"]
            document += [0] * (MAX_GAP + 1)
        terms, positions = (np.concatenate([np.asarray(part[c], np.int64) for part in parts]) for c in ("terms", "positions"))
        for k, most, every in lists.phrases(terms, positions):
            if int(lists.ids[k]) in asked:
                item = lists.items[k].tolist()
                found = judge(item, most, every, document)
                if found:
                    yield doc_id, int(lists.ids[k]), *found, len(item)

    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("run_words", pa.int32()), ("held_words", pa.int32()), ("own_words", pa.int32())])
    # Few bytes but much work: spread over all partitions, as sizes would put them into few tasks.
    pairs = candidates.join(whole, "doc_id").select("doc_id", "items", "parts").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_rows(pairs, cases, _CASES, arrow)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), Scratch(spark, "p7"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every leaked item the documents that hold it, and the longest run."""
    return _run(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("run_words").alias("longest_run"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLE: dict[str, str] = {}
