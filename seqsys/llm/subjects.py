"""Subject areas of pages by class-association rules.

Each page is cut once: into the pieces of its lines (menu entries, notices, paragraphs) and
their terms, which are written as hashes and serve everything that follows. A page's prose is what is left after its boilerplate:
pieces, of any length, that very many different bodies share. Terms that prefer some subject among the
labelled pages are kept; a run of a few of them is a transaction, together with the page's
label. Parallel frequent-pattern growth finds the frequent item sets, those with a
label become rules ``terms -> subject``, and a rule is pruned as redundant if a
shorter one predicts the same subject as well. Rules overlap, so their evidence, the log of confidence over
prior, is calibrated: it is scaled to fit labelled pages that were held out from mining. Every page is then read in the same
runs: the rules that match a run add their evidence, and the run's subject shares are the
normalised result. A page is about the subjects that hold enough of its runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsys.llm.text import page_rows, plain, readable
from seqsys.session import Scratch

_PIECE = r"\n|[|·>•»/]|\s{2,}|\s-\s"
# words; in Japanese, runs of katakana or of kanji (marks are folded away by `plain`)
_TERM = "[\u30a0-\u30ff]+|[\u4e00-\u9fff]+|[^\\W\\d_\u3040-\u30ff\u4e00-\u9fff]+"
_TOKEN = re.compile(f"{_TERM}|{_PIECE}")
_ENDS_PIECE = re.compile(_PIECE)


#: Texts are cut in groups of about so many bytes, which bounds a task's memory.
CUT_BYTES = 4 << 20


@dataclass(frozen=True)
class SubjectRules:
    """Parameters of mining and scoring."""

    max_labelled: int = 200_000  #: labelled pages used at most, chosen by the hash of their id
    held_out: int = 10  #: one labelled page in so many is held out to calibrate
    scales: tuple[float, ...] = (0.35, 0.5, 0.7, 1.0, 1.4)  #: of the evidence, from which calibration chooses
    boilerplate_share: float = 0.001  #: a piece with more than this share of the different texts as different bodies is boilerplate
    boilerplate_pages: int = 5  #: and on at least this many
    run: int = 5  #: kept terms per transaction
    support: float = 3e-4  #: relative support of an item set
    least_count: int = 3  #: absolute support of an item set
    term_share: float = 1e-3  #: of the labelled pages, that a kept term is on
    term_lift: float = 2.0  #: a kept term is this much more frequent under some subject
    confidence: float = 0.4  #: of a rule
    margin: float = 0.05  #: confidence a longer rule must add
    share: float = 0.25  #: of a page's runs that its subjects hold
    least_terms: int = 4  #: kept terms that make prose


def term_key(term: str) -> int:
    """A term as a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else values[:0]


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of texts and their terms: terms, terms per piece, key, letters and text of each piece.

    A piece's key follows from its terms in order, so digits and punctuation do not tell pieces apart.
    Pieces without a term are left out.
    """
    found = [_TOKEN.findall(plain(t)) for t in texts]
    coded = pa.array([x for f in found for x in f], pa.string()).dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    ends = np.array([bool(_ENDS_PIECE.fullmatch(x)) for x in kinds], bool)[code]
    new = ends.copy()
    new[1:] |= text[1:] != text[:-1]
    piece = np.cumsum(new)[~ends]
    code, text = code[~ends], text[~ends]
    terms = np.array([term_key(x) for x in kinds], np.int64)[code]
    begin = np.flatnonzero(np.diff(piece, prepend=piece[:1] - 1))
    size = np.diff(np.append(begin, len(code)))
    at = np.arange(len(code)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        key = _sums((terms.view(np.uint64) ^ (terms.view(np.uint64) >> np.uint64(31))) * power[at], begin).view(np.int64)
    letters = _sums(np.array([len(x) for x in kinds], np.int64)[code], begin)
    return terms, size, key, letters, text[begin]


def body_keys(key: np.ndarray, letters: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pieces at five points of each text's letters, its pieces taken from the longest; and the texts that have any.

    Copies of one body agree at most of the points though their wrappers differ, and different
    bodies differ at most of them though they share a menu or notice.
    """
    order = np.lexsort((key, -letters, text))
    ends = np.cumsum(letters[order])
    per = np.bincount(text, letters, n).astype(np.int64)
    have = np.flatnonzero(per)
    before = np.append(0, np.cumsum(per))[have]
    points = before[:, None] + per[have, None] * np.array([1, 3, 5, 7, 9]) // 10
    return key[order][np.searchsorted(ends, points, side="right")], have


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


_CUT = "page long, of long, pieces array<long>, sizes array<int>, terms array<long>, bodies array<long>"


def cut_pages(docs: DataFrame, doc: str, text: str, raw: str | None) -> DataFrame:
    """Rows ``page, of, pieces, sizes, terms, bodies`` of every page with a text; ``of`` is the hash of the text."""
    pages = page_rows(docs, doc, text, raw).withColumn("of", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # texts of a few million characters at a time, however long or many they are
            ends = np.cumsum(pc.binary_length(whole.column(1)).to_numpy()) // CUT_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                yield cut_batch(whole.slice(lo, hi - lo))

    def cut_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        terms, size, key, letters, of = cut([readable(*x) for x in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist())])
        bodies, have = body_keys(key, letters, of, n)
        pieces = np.bincount(of, minlength=n)
        per_page = np.bincount(of, size, n).astype(np.int64)
        five = np.zeros(n, np.int64)
        five[have] = 5
        columns = [b.column(0), b.column(4), _lists(key, pieces), _lists(size.astype(np.int32), pieces), _lists(terms, per_page), _lists(bodies.ravel(), five)]
        return pa.RecordBatch.from_arrays(columns, ["page", "of", "pieces", "sizes", "terms", "bodies"])

    return pages.mapInArrow(run, _CUT)


def boilerplate_keys(each: DataFrame, rules: SubjectRules, scratch: Scratch) -> np.ndarray:
    """Keys of the pieces shared by very many different bodies, ascending; at most (pieces per text) / (share) of them, whatever the corpus.

    Copies of one body count once, even where their menus, dates or footers differ, so that a hot
    group of mirrored pages is no boilerplate: the different bodies of a piece are the median count of its pages' `body_keys`.
    """
    n = each.select("of").distinct().count()
    limit = max(rules.boilerplate_pages, int(rules.boilerplate_share * n))
    # no piece has more bodies than rows, so few are left to look at
    often = each.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("piece")
    often = scratch.write(often, "often")
    rows = each.select("bodies", F.explode("pieces").alias("piece")).join(F.broadcast(often), "piece")
    bodies = rows.select("piece", F.posexplode("bodies").alias("at", "body")).distinct().groupBy("piece", "at").agg(F.count("*").alias("n"))
    middle = bodies.groupBy("piece").agg(F.array_sort(F.collect_list("n"))[2].alias("n"))
    return np.sort(np.array([r.piece for r in middle.filter(F.col("n") > limit).select("piece").collect()], np.int64))


def _member(values: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in an ascending array, and whether it is there."""
    if not len(ascending):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return at, ascending[at] == values


def _prose(b: pa.RecordBatch, boilerplate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the prose of a batch (columns pieces, sizes, terms at 0, 1, 2), and the row of each."""
    pieces, sizes, terms = (b.column(k).flatten().to_numpy() for k in range(3))
    row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
    kept = np.repeat(~_member(pieces, boilerplate)[1], sizes)
    return terms[kept], row[kept]


def _kept_terms(labelled: DataFrame, rules: SubjectRules) -> tuple[np.ndarray, dict[int, float]]:
    """Terms that prefer a subject, ascending, and the subjects' priors. Both are bounded by the labelled sample."""
    n = {r.subject: r.n for r in labelled.groupBy("subject").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    priors = {s: n[s] / total for s in sorted(n)}
    if not priors:
        return np.zeros(0, np.int64), {}
    each = labelled.select("subject", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term", "subject").agg(F.count("*").alias("n"))
    prior = F.create_map([x for s, p in priors.items() for x in (F.lit(s), F.lit(p))])
    per = each.withColumn("lift", F.col("n") / prior[F.col("subject")]).groupBy("term").agg(F.sum("n").alias("n"), F.max("lift").alias("most"))
    kept = per.filter((F.col("n") >= max(rules.least_count, rules.term_share * total)) & (F.col("most") / F.col("n") >= rules.term_lift))
    return np.sort(np.array([r.term for r in kept.select("term").collect()], np.int64)), priors


def _mine(transactions: DataFrame, priors: dict[int, float], rules: SubjectRules, scratch: Scratch) -> list[tuple[list[int], int, float]]:
    """Rules by parallel FP-growth, (terms, subject, confidence), redundant ones pruned.

    ``transactions`` has distinct items per row: numbers of kept terms, and -1 less the number of the label. The number of item
    sets is bounded by run length and relative support, not by the data.
    """
    n = transactions.count()
    if not n:
        return []
    support = max(rules.support, rules.least_count / n)
    # written, as the growth would run again for every branch below
    sets = scratch.write(FPGrowth(itemsCol="items", minSupport=min(1.0, support)).fit(transactions).freqItemsets, "sets")
    parts = sets.select(F.array_sort(F.filter("items", lambda x: x >= 0)).alias("terms"), F.filter("items", lambda x: x < 0).alias("labels"), "freq")
    parts = parts.filter((F.size("terms") > 0) & (F.size("labels") <= 1))
    bodies = parts.filter(F.size("labels") == 0).select("terms", F.col("freq").alias("n_body"))
    heads = parts.filter(F.size("labels") == 1).select("terms", (-1 - F.col("labels")[0]).alias("subject"), "freq")
    conf = heads.join(bodies, "terms").select("terms", "subject", (F.col("freq") / F.col("n_body")).alias("confidence")).filter(F.col("confidence") >= rules.confidence)
    prior = F.create_map([x for s, p in priors.items() for x in (F.lit(s), F.lit(p))])
    conf = scratch.write(conf.filter(F.col("confidence") > 1.5 * prior[F.col("subject")]), "rules")
    shorter = conf.select(F.col("terms").alias("s_terms"), F.col("subject").alias("s_subject"), F.col("confidence").alias("s_confidence"))
    # every shorter body: the terms at the bits of each number below 2 ** size - 1
    subsets = F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("terms")) - 2).cast("int")),
        lambda m: F.filter("terms", lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))
    less = conf.filter(F.size("terms") > 1).select("terms", "subject", "confidence", F.explode(subsets).alias("less"))
    redundant = less.join(shorter, (F.col("less") == F.col("s_terms")) & (F.col("subject") == F.col("s_subject")) & (F.col("s_confidence") + rules.margin >= F.col("confidence")))
    kept = conf.join(redundant.select("terms", "subject").distinct(), ["terms", "subject"], "left_anti")
    return [(list(r.terms), r.subject, r.confidence) for r in kept.collect()]


class Scorer:
    """Subject shares of runs of terms: the evidence of all matching rules, normalised."""

    def __init__(self, mined: list[tuple[list[int], int, float]], priors: dict[int, float], n_terms: int, run: int):
        self.subjects, self.run = sorted(priors), run
        place = {s: k for k, s in enumerate(self.subjects)}
        self.base = np.log(np.array([priors[s] for s in self.subjects]))
        self.single = np.zeros((n_terms, len(self.subjects)))
        # a body of several terms is known by the sum of their random numbers
        self.number = np.random.default_rng(20240611).integers(0, 1 << 63, n_terms, dtype=np.int64)
        bodies: dict[int, np.ndarray] = {}
        self.in_several = np.zeros(n_terms, bool)
        self.sizes = sorted({len(t) for t, _, _ in mined if len(t) > 1})
        for terms, s, confidence in mined:
            evidence = np.log(confidence / priors[s])
            if len(terms) == 1:
                self.single[terms[0], place[s]] += evidence
            else:
                with np.errstate(over="ignore"):
                    bodies.setdefault(int(self.number[terms].sum()), np.zeros(len(self.subjects)))[place[s]] += evidence
                self.in_several[terms] = True
        self.bodies = np.array(sorted(bodies), np.int64)
        self.several = np.array([bodies[k] for k in sorted(bodies)])

    def evidence(self, terms: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence, length and row of every run of the rows' terms; ``row`` ascends."""
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        at = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        first = at % self.run == 0
        run = np.cumsum(first) - 1
        n = int(run[-1]) + 1 if len(run) else 0
        # a term counts once in a run
        _, one = np.unique(run * len(self.number) + terms, return_index=True)
        r, t = run[one], terms[one]
        out = np.zeros((n, len(self.subjects)))
        for k in range(len(self.subjects)):
            out[:, k] = np.bincount(r, self.single[t, k], n)
        if len(self.bodies):
            keep = self.in_several[t]
            r, t = r[keep], t[keep]
            at = np.arange(len(r)) - np.searchsorted(r, r)
            table = np.full((n, self.run), -1, np.int64)
            table[r, at] = t
            for size in self.sizes:
                for columns in combinations(range(self.run), size):
                    rows = np.flatnonzero(table[:, columns[-1]] >= 0)
                    if len(rows):
                        with np.errstate(over="ignore"):
                            k, there = _member(self.number[table[np.ix_(rows, columns)]].sum(axis=1), self.bodies)
                        out[rows[there]] += self.several[k[there]]
        return out, np.bincount(run, minlength=n), row[first]

    def shares(self, evidence: np.ndarray, scale: float) -> np.ndarray:
        score = self.base + scale * evidence
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        return weight / weight.sum(axis=1, keepdims=True)


def _calibrated(held_out: DataFrame, scorer, rules: SubjectRules) -> float:
    """The scale of the evidence under which held-out labels are likeliest, each run counted by its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        place = {x: k for k, x in enumerate(s.subjects)}
        for b in batches:
            terms = b.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            evidence, length, of = s.evidence(terms.astype(np.int64), row)
            label = np.array([place.get(x, -1) for x in b.column(0).to_pylist()])[of] if len(of) else np.zeros(0, np.int64)
            ok = label >= 0
            # part of the labels is wrong, whatever the rules say
            loss = [float(-(length[ok] * np.log(0.05 / len(s.subjects) + 0.95 * s.shares(evidence[ok], x)[np.arange(ok.sum()),
                label[ok]])).sum()) if ok.any() else 0.0 for x in rules.scales]
            yield pa.RecordBatch.from_arrays([pa.array(rules.scales, pa.float64()), pa.array(loss, pa.float64())], ["scale", "loss"])

    found = held_out.mapInArrow(run, "scale double, loss double").groupBy("scale").agg(F.sum("loss").alias("loss")).collect()
    return min(((r.loss, r.scale) for r in found), default=(0.0, 1.0))[1]


def subjects(docs: DataFrame, labels: DataFrame, *, doc: str, text: str, raw: str | None, label_doc: str, label: str, allowed: list[str],
    rules: SubjectRules = SubjectRules()) -> DataFrame:
    """Rows ``doc, subject, share``: the one or two subjects that hold most of a page's prose.

    ``labels`` are noisy rows (doc, subject); labels and ``allowed`` are compared without regard to case and blanks, and
    subjects are returned as ``allowed`` writes them. Labels outside ``allowed`` are left out, repeats count once, and pages
    with two or more different labels are not mined. Null and
    blank texts, and pages without prose, give no row, nor does any page if there
    are no usable labels. Texts of any length are read whole. Other columns are not read.

    Corpus counts (boilerplate) and scoring cover every page; only mining and calibration are done on the
    labelled sample, of at most ``rules.max_labelled`` pages.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "subjects")
    pages = scratch.write(cut_pages(docs, doc, text, raw), "pages")
    boilerplate = spark.sparkContext.broadcast(boilerplate_keys(pages, rules, scratch))

    names = sorted({x for x in allowed if x and x.strip()})
    number = {" ".join(x.lower().split()): k for k, x in enumerate(names)}
    if not number:
        return spark.createDataFrame([], "doc long, subject string, share double")
    numbers = F.create_map([x for name, k in number.items() for x in (F.lit(name), F.lit(k))])
    name = F.lower(F.trim(F.regexp_replace(F.col(label), r"\s+", " ")))
    known = labels.select(F.col(label_doc).cast("long").alias("page"), numbers[name].alias("subject")).dropna().distinct()
    one = known.groupBy("page").agg(F.count("*").alias("n"), F.min("subject").alias("subject")).filter(F.col("n") == 1)
    sample = one.orderBy(F.xxhash64("page"), "page").limit(rules.max_labelled).select("page", "subject")

    def prose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, row = _prose(b, boilerplate.value)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), _lists(terms, np.bincount(row, minlength=b.num_rows))], ["page", "subject", "terms"])

    labelled = pages.join(F.broadcast(sample), "page").select("pieces", "sizes", "terms", "page", "subject")
    labelled = labelled.mapInArrow(prose, "page long, subject int, terms array<long>").filter(F.size("terms") > 0)
    labelled = scratch.write(labelled.withColumn("held_out", F.pmod(F.xxhash64("page", F.lit(1)), F.lit(rules.held_out)) == 0), "labelled")
    kept, priors = _kept_terms(labelled.filter(~F.col("held_out")), rules)
    vocabulary = spark.sparkContext.broadcast(kept)
    k = rules.run

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, there = _member(b.column(2).flatten().to_numpy(), vocabulary.value)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            mine = _lists(at[there].astype(np.int32), np.bincount(row[there], minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), mine], ["subject", "held_out", "terms"])

    mine = scratch.write(labelled.select("subject", "held_out", "terms").mapInArrow(numbered,
        "subject int, held_out boolean, terms array<int>").filter(F.size("terms") > 0), "numbered")
    starts = F.sequence(F.lit(1), F.size("terms"), F.lit(k))
    runs = mine.filter(~F.col("held_out")).select("subject", "terms", F.explode(starts).alias("i"))
    runs = scratch.write(runs.select(F.concat(F.array_distinct(F.slice("terms", F.col("i"), k)), F.array(-1 - F.col("subject"))).alias("items")), "runs")
    mined = _mine(runs, priors, rules, scratch) if priors else []
    scorer = spark.sparkContext.broadcast(Scorer(mined, priors, len(kept), k))
    scale = _calibrated(mine.filter("held_out").select("subject", "terms"), scorer, rules) if mined else 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for b in batches:
            terms, row = _prose(b, boilerplate.value)
            at, there = _member(terms, vocabulary.value)
            at, row = at[there], row[there]
            n = np.bincount(row, minlength=b.num_rows)
            prose_ = n[row] >= rules.least_terms
            if not s.subjects or not prose_.any():
                continue
            evidence, length, of = s.evidence(at[prose_], row[prose_])
            shares = s.shares(evidence, scale) * length[:, None]
            total = np.stack([np.bincount(of, shares[:, x], b.num_rows) for x in range(len(s.subjects))], axis=1)
            rows = np.flatnonzero(n >= rules.least_terms)
            total = total[rows] / n[rows, None]
            order = np.argsort(-total, axis=1, kind="stable")[:, :2]
            value = np.take_along_axis(total, order, axis=1)
            r, c = np.nonzero(value >= rules.share)
            subject = [names[s.subjects[x]] for x in order[r, c]]
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(rows[r])), pa.array(subject, pa.string()), pa.array(value[r, c])], ["doc", "subject", "share"])

    return pages.select("pieces", "sizes", "terms", "page").mapInArrow(score, "doc long, subject string, share double")
