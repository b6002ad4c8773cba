"""Test passages inside a corpus, by a distributed positional inverted index.

The index holds the postings of every token of the corpus, whatever the tests are. It is
partitioned by pages into segments of bounded length; in a segment the tokens of its
pages stand one after the other, and the places of a term are one ascending list. Segments are
written as a table of rows (segment, term), so a lookup reads the terms it wants.

A search fetches the lists of the tests' words, which lay the tests' words out along each
segment: pairs of neighbouring words are list intersections at distance one. Of every run and
sentence of a test the pairs with the shortest lists are looked up first, whatever their length, and
their places are shifted by the pair's place in the test: where a few of them agree on an offset, or
most sentences of a passage are met anywhere, the page is laid against the test, by a
weighted common subsequence of their words in order, so that changed, dropped and inserted words cost
their weight only. Words weigh by their rarity in the corpus, which keeps pages apart that merely use
the same turns of phrase. All places come from the index; no text is read twice.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsys.llm.text import page_rows, readable, words
from seqsys.session import Scratch

#: The tests are read on the driver and held by every task; more items than this are refused.
MAX_ITEMS = 20_000
#: Tokens of a segment; a longer page is a segment of its own.
SEGMENT_TOKENS = 1 << 20

_SENTENCE = re.compile(r"(?<=[.!?\"»“”])\s+(?=[\"«„“¿¡]?[^\W\d_a-z])")


@dataclass(frozen=True)
class LeakRules:
    """What counts as a leak."""

    run: int = 24  #: running words that make a leak
    run_share: float = 0.84  #: weight of a run that the page must reproduce
    sentence_share: float = 0.7  #: the same for every sentence of a scattered passage
    least_pairs: int = 5  #: pairs of every run and sentence that are looked up, however frequent
    rare_share: float = 0.008  #: looked up as well are pairs on at most this share of the pages more than the rarest of their run,
    stock_share: float = 0.015  #: unless they stand in more than this share of the tests' texts
    min_hits: int = 3  #: looked-up pairs at agreeing offsets that make a candidate,
    hit_share: float = 0.4  #: if they hold this share of the information of a run's looked-up pairs; the same for sentences
    drift: int = 8  #: words by which offsets may disagree
    common: float = 1.8  #: inverse document frequency (natural log) up to which a word is a turn of phrase
    least_weight: float = 0.15  #: weight of such words
    most_weight: float = 4.0  #: weight of the rarest words


@dataclass(frozen=True)
class TestText:
    """A passage or a question without its stock instruction; items with the same text share it."""

    words: np.ndarray  #: word numbers, from 1
    spans: list[tuple[int, int]]  #: its sentences
    is_passage: bool
    items: list[int]


def test_texts(rows: list[tuple[int, str | None, str | None]], shared: int = 5) -> tuple[list[TestText], list[str]]:
    """The texts of the items, and the words in the order of their numbers.

    An opening sentence that ``shared`` or more questions have is a stock
    instruction and left out. Null and empty texts give nothing.
    """
    opening = Counter(_SENTENCE.split(q.strip())[0] for _, _, q in rows if q)
    number: dict[str, int] = defaultdict(lambda: len(number) + 1)
    found: dict[tuple, list[int]] = defaultdict(list)
    for item, passage, question in rows:
        q = question
        if q and opening[_SENTENCE.split(q.strip())[0]] >= shared:
            q = " ".join(_SENTENCE.split(q.strip())[1:])
        for text, is_passage in ((passage, True), (q, False)):
            spans, all_words = [], []
            for s in _SENTENCE.split(text.strip()) if text else []:
                w = [number[x] for x in words(s)]
                if w:
                    spans.append((len(all_words), len(all_words) + len(w)))
                    all_words += w
            if all_words:
                found[is_passage, tuple(all_words), tuple(spans)].append(item)
    return [TestText(np.array(w, np.int32), list(s), p, sorted(set(i))) for (p, w, s), i in found.items()], list(number)


def common_subsequence(item: np.ndarray, weight: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Which words of ``item`` lie on its heaviest common subsequence with ``region``; both are word numbers."""
    kept = np.zeros(len(item), bool)
    # words that only one side has are on no common subsequence
    rows = np.flatnonzero(np.isin(item, region))
    a, w = item[rows], weight[rows]
    b = region[np.isin(region, a)]
    n, m = len(a), len(b)
    if not n:
        return kept
    best = np.zeros((n + 1, m + 1))
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], np.where(b == a[i], best[i, :-1] + w[i], 0)))
    i, j = n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            kept[rows[i - 1]] = True
            i, j = i - 1, j - 1
    return kept


def _reach(length: int, drift: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For every block of ``drift`` page words, the first and last (exclusive) block that ``length`` words that begin in it may reach."""
    b = np.arange(blocks)
    return np.maximum(b - 1, 0), np.minimum(b + 2 - (-length // drift), blocks)


def leaked(page: np.ndarray, text: TestText, weight: np.ndarray, rules: LeakRules, offset: int | None = None) -> bool:
    """Does the page reproduce a run of the item's words, or all sentences of its passage?

    Words are numbers; those of the page that no test has are 0. A straight copy at ``offset`` is seen at once.
    Else every place of the page is asked: those whose words, in any order, weigh too little are left
    out, which cannot lose any, and all others are laid against the item.
    """
    item, spans, is_passage = text.words, text.spans, text.is_passage
    total = np.append(0, np.cumsum(weight))
    n, d = len(item), rules.drift
    wanted = total[rules.run :] - total[: -rules.run]
    if offset is not None and n >= rules.run:
        lo, hi = max(0, -offset), min(n, len(page) - offset)
        if hi > lo:
            same = np.zeros(n, bool)
            same[lo:hi] = item[lo:hi] == page[offset + lo : offset + hi]
            got = np.append(0, np.cumsum(weight * same))
            if ((got[rules.run :] - got[: -rules.run]) / wanted).max() >= rules.run_share:
                return True
    kinds, first, number = np.unique(item, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(kinds, page), len(kinds) - 1)
    met = np.flatnonzero(kinds[at] == page)
    blocks = -(-len(page) // d)
    # running sums by block: of the weight of all words at first, for it rules most places out, then of each word
    heavy = np.append(0, np.cumsum(np.bincount(met // d, (weight[first] * np.bincount(number))[at[met]], blocks)))

    def rows_of(length: int, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = _reach(length, d, blocks)
        rows = np.flatnonzero(heavy[hi] - heavy[lo] >= wanted - 1e-9)
        return rows, lo[rows], hi[rows]

    in_runs = rows_of(rules.run, rules.run_share * wanted.min()) if n >= rules.run else None
    in_sentences = [rows_of(z - a, rules.sentence_share * (total[z] - total[a])) for a, z in spans] if is_passage else []
    if (in_runs is None or not len(in_runs[0])) and not (is_passage and all(len(x[0]) for x in in_sentences)):
        return False
    there = np.zeros((blocks + 1, len(kinds)), np.int32)
    there[met // d + 1, at[met]] = 1
    seen = np.cumsum(there, axis=0, dtype=np.int32)
    if in_runs is not None:
        rows, lo, hi = in_runs
        most = np.cumsum(np.where((seen[hi] > seen[lo])[:, number], weight, 0), axis=1)
        most = np.concatenate([np.zeros((len(rows), 1)), most], axis=1)
        most = (most[:, rules.run :] - most[:, : -rules.run]) / wanted
        row, start = np.nonzero(most >= rules.run_share - 1e-9)
        best = np.argsort(-most[row, start], kind="stable")
        for o in dict.fromkeys((rows[row] * d - start)[best].tolist()):
            kept = common_subsequence(item, weight, page[max(0, o - d) : max(0, o + n + 2 * d)])
            got = np.append(0, np.cumsum(weight * kept))
            if ((got[rules.run :] - got[: -rules.run]) / wanted).max() >= rules.run_share:
                return True
    if not is_passage:
        return False
    places = []
    for (a, z), (rows, lo, hi) in zip(spans, in_sentences):
        least = rules.sentence_share * (total[z] - total[a])
        most = np.where((seen[hi] > seen[lo])[:, number[a:z]], weight[a:z], 0).sum(axis=1)
        places.append([rows[k] * d for k in np.argsort(-most, kind="stable") if most[k] >= least - 1e-9])
        if not places[-1]:
            return False
    for (a, z), starts in zip(spans, places):
        for o in starts:
            kept = common_subsequence(item[a:z], weight[a:z], page[max(0, o - d) : o + z - a + 2 * d])
            if (weight[a:z] * kept).sum() >= rules.sentence_share * (total[z] - total[a]):
                break
        else:
            return False
    return True


def term_key(word: str) -> int:
    """A word as a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _segment(pages: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    """Rows (segment, term, n_pages, places) of some pages, ascending by term.

    Places are 32-bit; each page is followed by one free place, so that no pair crosses pages. The row
    without a term holds the pages and their first places, as pairs of 64-bit numbers.
    """
    lens = np.array([len(w) for _, w in pages], np.int64)
    starts = np.append(0, np.cumsum(lens + 1))[:-1]
    coded = pa.array([w for _, ws in pages for w in ws], pa.string()).dictionary_encode()
    keys = np.array([term_key(w) for w in coded.dictionary.to_pylist()], np.int64)
    up = np.argsort(keys)
    place_of = np.empty(len(keys), np.int64)
    place_of[up] = np.arange(len(keys))
    code = place_of[coded.indices.to_numpy(zero_copy_only=False)]
    page = np.repeat(np.arange(len(pages)), lens)
    place = (np.arange(len(code)) + page).astype("<i4")
    order = np.argsort(code, kind="stable")
    n = np.bincount(code, minlength=len(keys))
    at = np.append(0, np.cumsum(n))[:-1]
    c, p = code[order], page[order]
    fresh = np.ones(len(c), np.int64)
    fresh[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    table = np.stack([np.array([k for k, _ in pages], np.int64), starts], 1).astype("<i8").tobytes()
    data = place[order].tobytes() + table
    offsets = np.concatenate([[0], np.cumsum(n) * 4, [len(data)]]).astype(np.int32)
    rows = len(keys) + 1
    n_pages = np.append(np.add.reduceat(fresh, at) if len(c) else [], len(pages)).astype(np.int32)
    terms = pa.array(np.append(keys[up], 0), pa.int64(), mask=np.append(np.zeros(len(keys), bool), True))
    places = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    name = pa.array([uuid.uuid4().hex] * rows, pa.string())
    return pa.RecordBatch.from_arrays([name, terms, pa.array(n_pages), places], ["segment", "term", "n_pages", "places"])


def positional_index(docs: DataFrame, *, doc: str, text: str, raw: str | None, scratch: Scratch) -> DataFrame:
    """The written index of all tokens of a corpus: rows ``segment, term, n_pages, places``, see `_segment`.

    It does not depend on the tests, so that later ones can be looked up in it. Pages with a null
    id, and null, empty and blank texts are left out. Segments are made where the pages are read; nothing is shuffled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for page, t, garbled, r in zip(*(b.column(k).to_pylist() for k in range(4))):
                w = words(readable(t, r, garbled))
                if not w:
                    continue
                if held and size + len(w) > SEGMENT_TOKENS:
                    yield _segment(held)
                    held, size = [], 0
                held.append((page, w))
                size += len(w)
        if held:
            yield _segment(held)

    return scratch.write(page_rows(docs, doc, text, raw).mapInArrow(build, "segment string, term long, n_pages int, places binary"), "index")


def _column(data: np.ndarray) -> pa.Array:
    return pa.array([data.tobytes()], pa.binary())


def _laid_out(pairs: np.ndarray, n_words: int):
    """Function of a segment's lists (number, places) to its row (segment, pages, stream, pair, pages_with_pair).

    The stream has the number of a test's word at each of its places and 0 elsewhere.
    """

    def run(t: pa.Table) -> pa.Table:
        numbers = t.column("number").to_pylist()
        lists = t.column("places").to_pylist()
        table = next(np.frombuffer(p, "<i8").reshape(-1, 2) for k, p in zip(numbers, lists) if k is None)
        found = [(k, np.frombuffer(p, "<i4")) for k, p in zip(numbers, lists) if k is not None]
        stream = np.zeros(max((int(p[-1]) for _, p in found), default=0) + 2, "<i4")
        for k, p in found:
            stream[p] = k
        at, pair = pair_places(stream, pairs, n_words)
        page = np.searchsorted(table[:, 1], at, side="right") - 1
        both = np.unique(pair.astype(np.int64) * len(table) + page) // max(len(table), 1)
        kinds, n = np.unique(both, return_counts=True)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32), kind))
        columns = [pa.array([t.column("segment")[0].as_py()]), _column(table), _column(stream), one(kinds, pa.int32()), one(n, pa.int32())]
        return pa.table(columns, ["segment", "pages", "stream", "pair", "n"])

    return run


def pair_keys(words_: np.ndarray, n_words: int) -> np.ndarray:
    """Pairs of neighbouring words as one number each."""
    return words_[:-1].astype(np.int64) * (n_words + 1) + words_[1:]


def pair_places(stream: np.ndarray, pairs: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stream where a pair of the tests begins, and the pairs' numbers; ``pairs`` are ascending keys."""
    at = np.flatnonzero((stream[:-1] > 0) & (stream[1:] > 0))
    key = pair_keys(stream, n_words)[at]
    k = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
    ok = pairs[k] == key if len(pairs) else np.zeros(len(at), bool)
    return at[ok], k[ok]


def looked_up(text: TestText, n: np.ndarray, times: np.ndarray, limit: int, stock: int, rules: LeakRules) -> np.ndarray:
    """Places of a text whose pairs are looked up: those with the shortest lists of their run of words or sentence.

    ``n`` counts the pages of each pair and ``times`` the places of the tests it stands at; a list is entered once for each.
    In every run and every sentence the ``least_pairs`` shortest are looked up, whatever their length, so that an item on very many
    pages or a passage of many items is looked up as well as others; then those on at most ``limit`` pages more than the rarest of it that
    stand at no more than ``stock`` places.
    """
    cost = n.astype(float) * times
    chosen = np.zeros(len(n), bool)

    def choose(lo: int, hi: int, width: int) -> None:
        """All windows of ``width`` pairs between two places at once."""
        see = lambda x: np.lib.stride_tricks.sliding_window_view(x[lo:hi], width)
        c, few = see(cost), see(n)
        k = min(rules.least_pairs, width) - 1
        take = (c <= np.partition(c, k, axis=1)[:, k, None]) | ((few <= few.min(axis=1, keepdims=True) + limit) & (see(times) <= stock))
        for x in range(width):
            chosen[lo + x : lo + x + len(take)] |= take[:, x]

    if len(n) >= rules.run - 1:
        choose(0, len(n), rules.run - 1)
    for a, z in text.spans if text.is_passage else []:
        if z - a > 1:
            choose(a, z - 1, z - a - 1)
    return np.flatnonzero(chosen)


@dataclass(frozen=True)
class Lookup:
    """The tests as they are looked up: the places of every pair, as slices of arrays with one entry per place."""

    texts: list[TestText]
    weights: list[np.ndarray]
    pairs: np.ndarray
    n_words: int
    begin: np.ndarray  #: first entry of each pair
    text: np.ndarray
    place: np.ndarray
    sentence: np.ndarray  #: number of the sentence, counted over all texts
    information: np.ndarray  #: of the pair, the logarithm of its rarity
    run_needs: np.ndarray  #: information that makes a candidate, per text
    sentence_needs: np.ndarray  #: the same per sentence
    first_sentence: np.ndarray  #: of each text, and the end
    needed: np.ndarray  #: sentences of a text that make a candidate; more than it has for questions


def prepare(texts: list[TestText], vocabulary: list[str], word_pages: np.ndarray, pairs: np.ndarray, pair_pages: np.ndarray, n_pages: int, rules: LeakRules) -> Lookup:
    """Weights of the words, and what is looked up of every text, from the pages that words and pairs are on."""
    idf = np.log(max(n_pages, 1) / (word_pages + 1))
    weights = [np.clip(idf[t.words] - rules.common, rules.least_weight, rules.most_weight) for t in texts]
    limit, stock = max(5, int(rules.rare_share * n_pages)), max(2, int(rules.stock_share * len(texts)))
    rarity = np.maximum(np.log(max(n_pages, 1) / (pair_pages + 1)), rules.least_weight)
    each = [np.searchsorted(pairs, pair_keys(t.words, len(vocabulary))) for t in texts]
    times = np.bincount(np.concatenate([*each, np.zeros(0, np.int64)]).astype(np.int64), minlength=len(pairs))
    first = np.append(0, np.cumsum([len(t.spans) for t in texts])).astype(np.int64)
    columns: list[list[np.ndarray]] = [[], [], [], []]
    run_needs, sentence_needs = np.zeros(len(texts)), np.full(first[-1], np.inf)
    for k, (t, number) in enumerate(zip(texts, each)):
        sentence = np.repeat(np.arange(first[k], first[k + 1]), [z - a for a, z in t.spans])
        j = looked_up(t, pair_pages[number], times[number], limit, stock, rules) if len(number) else np.zeros(0, np.int64)
        for column, values in zip(columns, (number[j], np.full(len(j), k), j, sentence[j])):
            column.append(values)
        held = np.append(0, np.cumsum(np.bincount(j, rarity[number[j]], len(t.words))))
        wide = min(rules.run, len(t.words))
        run_needs[k] = rules.hit_share * (held[wide:] - held[:-wide]).min()
        for x, (a, z) in enumerate(t.spans):
            sentence_needs[first[k] + x] = rules.hit_share * max(held[z] - held[a], 1e-9)
    pair, of, place, sentence = (np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in columns)
    o = np.argsort(pair, kind="stable")
    needed = np.array([math.ceil(rules.sentence_share * len(t.spans)) if t.is_passage else len(t.spans) + 1 for t in texts], np.int64)
    begin = np.searchsorted(pair[o], np.arange(len(pairs) + 1))
    return Lookup(texts, weights, pairs, len(vocabulary), begin, of[o], place[o], sentence[o], rarity[pair[o]], run_needs, sentence_needs, first, needed)


def candidates(stream: np.ndarray, starts: np.ndarray, look: Lookup, rules: LeakRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages (by place in ``starts``), texts and best offsets where looked-up pairs agree that hold enough information."""
    at, pair = pair_places(stream, look.pairs, look.n_words)
    times = look.begin[pair + 1] - look.begin[pair]
    entry = np.repeat(look.begin[pair] - np.append(0, np.cumsum(times))[:-1], times) + np.arange(times.sum())
    at = np.repeat(at, times)
    page = np.searchsorted(starts, at, side="right") - 1
    place = look.place[entry]
    offset = at - starts[page] - place
    together, of = np.unique(page * len(look.texts) + look.text[entry], return_inverse=True)
    if not len(together):
        return together, together, together
    text = together % len(look.texts)
    long = int(look.place.max()) + 1
    # most sentences, anywhere
    _, one = np.unique(of * long + place, return_index=True)
    met, which = np.unique(of[one] * len(look.sentence_needs) + look.sentence[entry[one]], return_inverse=True)
    enough = np.bincount(which, look.information[entry[one]]) >= look.sentence_needs[met % len(look.sentence_needs)] - 1e-9
    ok = np.bincount(met[enough] // len(look.sentence_needs), minlength=len(together)) >= look.needed[text]
    # different places of the text in one band of twice the drift
    low = offset.min()
    for shift in (0, rules.drift):
        band = (offset - low + shift) // (2 * rules.drift)
        wide = int(band.max()) + 1
        _, one = np.unique((of * wide + band) * long + place, return_index=True)
        bands, which, n = np.unique(of[one] * wide + band[one], return_inverse=True, return_counts=True)
        mine = bands // wide
        ok[mine[(n >= rules.min_hits) & (np.bincount(which, look.information[entry[one]]) >= look.run_needs[text[mine]] - 1e-9)]] = True
    # the offset that most pairs agree on
    span = int((offset - low).max()) + 1
    agreed, n = np.unique(of * span + (offset - low), return_counts=True)
    order = np.lexsort((-n, agreed // span))
    top = order[np.searchsorted((agreed // span)[order], np.arange(len(together)))]
    best = agreed[top] % span + low
    return together[ok] // len(look.texts), text[ok], best[ok]


def leaks(docs: DataFrame, tests: DataFrame, *, doc: str, text: str, raw: str | None, item: str, passage: str, question: str,
    rules: LeakRules = LeakRules()) -> DataFrame:
    """Rows ``doc, item``: pages that reproduce a test item's passage or question.

    A page is one row; its garbled text is read from ``raw`` bytes where given. Null and
    empty texts leak nothing, texts of any length are read whole, and repeated
    pages each count. The tests are a stated set of at most `MAX_ITEMS` items, held by
    every task; items with one text are looked up once and each reported. Empty corpora or tests give no row.
    Other columns are not read. No term, page or place is left out for being frequent.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    index = positional_index(docs, doc=doc, text=text, raw=raw, scratch=scratch)
    return leaks_in_index(index, tests, item=item, passage=passage, question=question, scratch=scratch, rules=rules)


def leaks_in_index(index: DataFrame, tests: DataFrame, *, item: str, passage: str, question: str, scratch: Scratch, rules: LeakRules = LeakRules()) -> DataFrame:
    """`leaks` of tests in a written `positional_index`."""
    spark = index.sparkSession
    rows = tests.select(F.col(item).cast("long"), passage, question).filter(F.col(item).isNotNull()).limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} test items")
    texts, vocabulary = test_texts(sorted({tuple(r) for r in rows}, key=repr))
    v = len(vocabulary)
    pairs = np.unique(np.concatenate([pair_keys(t.words, v) for t in texts] + [np.zeros(0, np.int64)]))
    # the words of the tests bound this table and what comes to the driver below
    numbered = pa.table({"term": pa.array([term_key(w) for w in vocabulary], pa.int64()), "number": pa.array(range(1, v + 1), pa.int32())})
    wanted = F.broadcast(spark.createDataFrame(numbered))
    lists = index.join(wanted, "term").select("segment", "number", "n_pages", "places")
    tables = index.filter(F.col("term").isNull()).select("segment", F.lit(None).cast("int").alias("number"), "n_pages", "places")
    counted = {r.number: r.n for r in lists.unionByName(tables).groupBy("number").agg(F.sum("n_pages").alias("n")).collect()}
    n_pages = counted.get(None, 0)
    word_pages = np.array([counted.get(k, 0) for k in range(v + 1)])

    laid = lists.unionByName(tables).groupBy("segment").applyInArrow(_laid_out(pairs, v), "segment string, pages binary, stream binary, pair array<int>, n array<int>")
    laid = scratch.write(laid, "streams")
    on = laid.select(F.explode(F.arrays_zip("pair", "n")).alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n")).collect()
    pair_pages = np.zeros(len(pairs), np.int64)
    for r in on:
        pair_pages[r.pair] = r.n
    held = spark.sparkContext.broadcast(prepare(texts, vocabulary, word_pages, pairs, pair_pages, n_pages, rules))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = held.value
        for b in batches:
            for pages_, stream_ in zip(b.column(0), b.column(1)):
                table = np.frombuffer(pages_.as_buffer(), "<i8").reshape(-1, 2)
                stream = np.frombuffer(stream_.as_buffer(), "<i4")
                ends = np.append(table[1:, 1] - 1, len(stream))
                out_d, out_i = [], []
                for p, x, o in zip(*(c.tolist() for c in candidates(stream, table[:, 1], look, rules))):
                    if leaked(stream[table[p, 1] : ends[p]], look.texts[x], look.weights[x], rules, o):
                        out_d += [int(table[p, 0])] * len(look.texts[x].items)
                        out_i += look.texts[x].items
                yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_i, pa.int64())], ["doc", "item"])

    return laid.select("pages", "stream").mapInArrow(search, "doc long, item long").distinct()
