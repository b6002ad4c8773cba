"""Co-occurrence of annotations on contigs: windows, orientation, normalisation, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsys.operators.intervals import with_run_index
from seqsys.session import Scratch, shuffles_freed

#: Orientation codes 2 * direction(later) + direction(earlier), f = 0, r = 1.
ORIENTATIONS = {0: "forward", 1: "outward", 2: "inward", 3: "reverse"}


def gene_ranks(genes: DataFrame) -> DataFrame:
    """Replace coordinates by the gene's rank along its contig; genes of one start share a rank."""
    ranked = with_run_index(genes, "start", ["contig"], ["start"], "_rank")
    return ranked.withColumns({"start": F.col("_rank"), "stop": F.col("_rank")}).drop("_rank")


def window_pairs(genes: DataFrame, w: int, by_rank: bool = False) -> DataFrame:
    """Ordered pairs of annotations on one contig: ``contig, later, earlier, orientation`` and the positions.

    ``genes``: ``contig, start, stop, direction (f/r), accession``, and a unique ``row``. A pair is
    the later row i with each earlier row j whose stop lies behind i's start or whose
    start is at most ``w`` before it. With ``by_rank`` distances count genes, and ``w = 0`` pairs
    annotations of equal start.

    Rows are joined within bins of width ``w`` along the contig (the row's bin and, for the
    earlier side, every bin its reach touches), so a contig with very many rows is spread.
    """
    g = gene_ranks(genes) if by_rank else genes
    g = g.select("contig", "start", "stop", "direction", "accession", "row")
    width = max(w, 1) if by_rank else max(w, 1000)
    reach = F.greatest(F.col("stop") - 1, F.col("start") + w)
    i = g.select("contig", F.col("start").alias("s_i"), F.col("stop").alias("e_i"), F.col("direction").alias("d_i"),
        F.col("accession").alias("later"), F.col("row").alias("r_i"), F.floor(F.col("start") / width).alias("bin"))
    j = g.select("contig", F.col("start").alias("s_j"), F.col("stop").alias("e_j"), F.col("direction").alias("d_j"),
        F.col("accession").alias("earlier"), F.col("row").alias("r_j"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(reach / width))).alias("bin"))
    before = (F.col("s_j") < F.col("s_i")) | ((F.col("s_j") == F.col("s_i")) & (F.col("r_j") < F.col("r_i")))
    near = (F.col("e_j") > F.col("s_i")) | (F.col("s_i") - F.col("s_j") <= w)
    pairs = i.join(j, ["contig", "bin"]).filter(before & near)
    if by_rank and w != 0:
        pairs = pairs.filter((F.col("e_j") != F.col("s_i")) | (F.col("s_j") != F.col("s_i")))
    code = 2 * (F.col("d_i") == "r").cast("int") + (F.col("d_j") == "r").cast("int")
    return pairs.select("contig", "later", "earlier", code.alias("orientation"), "s_i", "s_j", "r_i", "r_j")


def pair_counts(pairs: DataFrame, cap_per_contig: bool = True, group: DataFrame | None = None) -> DataFrame:
    """``later, earlier, orientation, n``: distinct contigs (or groups), or all instances if not capped.

    ``group`` maps ``contig`` to ``group``; with it, distinct groups are counted.
    """
    if group is not None:
        pairs = pairs.join(group.select("contig", "group"), "contig")
    unit = "group" if group is not None else "contig"
    return pairs.groupBy("later", "earlier", "orientation").agg((F.count_distinct(unit) if cap_per_contig else F.count("*")).alias("n"))


def symmetric_counts(counts: DataFrame) -> DataFrame:
    """``a, b, total, inward, outward, forward, reverse`` for both orders of each pair.

    forward(a, b) counts co-directional pairs in which a is 5' of b; a pair of one
    accession has no forward or reverse count and doubled others.
    """
    n = lambda *codes: F.sum(F.when(F.col("orientation").isin(*codes), F.col("n")).otherwise(0))
    o = lambda code: F.when(F.col("orientation") == code, F.col("n")).otherwise(0)
    same = F.col("later") == F.col("earlier")
    straight = counts.select(F.col("later").alias("a"), F.col("earlier").alias("b"), "orientation", "n", F.when(same, 0).otherwise(o(3)).alias("fw"),
        F.when(same, 0).otherwise(o(0)).alias("rv"))
    swapped = counts.select(F.col("earlier").alias("a"), F.col("later").alias("b"), "orientation", "n", F.when(same, 0).otherwise(o(0)).alias("fw"),
        F.when(same, 0).otherwise(o(3)).alias("rv"))
    return straight.unionByName(swapped).groupBy("a", "b").agg(F.sum("n").alias("total"), n(2).alias("inward"), n(1).alias("outward"),
        F.sum("fw").alias("forward"), F.sum("rv").alias("reverse"))


def normalise(counts: DataFrame, singles: DataFrame) -> DataFrame:
    """Add hyperz and jacc (by marginals and groups), cond (by both and by contigs) and pmi to ``a, b, total``.

    ``singles``: ``accession, instances, contigs`` and maybe ``groups`` from `frequencies`; without groups each contig is one.
    Marginals are row sums of the symmetric counts, which are written once. A pair counted as often as both of its ends
    together has an infinite jacc, as orientations and orders are counted apart.
    """
    counts = Scratch(counts.sparkSession, "norms").write(counts.select("a", "b", "total"), "counts")
    marg = counts.groupBy("a").agg(F.sum("total").alias("m"))
    # one row: the sum of all counts
    total = counts.agg(F.sum("total").alias("all_pairs"))
    s = singles.select("accession", F.col("instances").alias("i"), F.col("contigs").alias("c"), F.col("groups" if "groups" in singles.columns else "contigs").alias("g"))
    s = s.join(marg.withColumnRenamed("a", "accession"), "accession")
    x = counts.join(s.toDF("a", "i_a", "c_a", "g_a", "m_a"), "a").join(s.toDF("b", "i_b", "c_b", "g_b", "m_b"), "b").join(F.broadcast(total))
    return _norms(x)


def _norms(x: DataFrame) -> DataFrame:
    """The columns of `normalise` from a pair's ``total``, its ends' ``i, c, g, m`` and ``all_pairs``."""
    n = F.col("total").cast("double")
    out: dict[str, Column] = {}
    for kind, p, q in (("marg", F.col("m_a"), F.col("m_b")), ("groups", F.col("g_a"), F.col("g_b"))):
        out[f"hyperz_{kind}"] = n / (p * q)
        out[f"jacc_{kind}"] = F.when(p + q == n, F.lit(float("inf"))).otherwise(n / (p + q - n))
        out[f"cond_{kind}"] = n / p
    out["cond_contigs"] = n / F.col("c_a")
    out["pmi_instances"] = F.log(n * F.col("all_pairs") / (F.col("i_a") * F.col("i_b")))
    return x.select("a", "b", "total", *[v.alias(k) for k, v in out.items()])


def coded(genes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``genes`` with numbers for contigs, accessions and, among genes of one start, rows; and ``code, accession, instances, contigs``.

    Numbers make the tables of pairs a third of the size. ``row`` keeps its order where `window_pairs` looks at it.
    """
    with shuffles_freed(genes.sparkSession):
        g = scratch.write(genes.select("contig", "start", "stop", "direction", "accession", "row"), "genes")
        path = scratch.last
        per = g.groupBy("accession").agg(F.count("*").alias("instances"), F.count_distinct("contig").alias("contigs"))
        singles = scratch.write(per.withColumn("code", F.monotonically_increasing_id()), "singles")
        contigs = scratch.write(g.select("contig").distinct().withColumn("_c", F.monotonically_increasing_id()), "contigs")
        numbered = g.join(contigs, "contig").join(singles.select("accession", F.col("code").alias("_a")), "accession")
        place = F.row_number().over(Window.partitionBy("_c", "start").orderBy("row"))
        out = scratch.write(numbered.select(F.col("_c").alias("contig"), "start", "stop", "direction", F.col("_a").alias("accession"), place.alias("row")), "coded")
    scratch.drop(path)
    return out, singles


def window_norms(genes: DataFrame, w: int) -> DataFrame:
    """`normalise` of the symmetric counts of contigs whose genes stand within ``w``, contigs as groups.

    The same rows as by `symmetric_counts`, but each pair of accessions is one row until the end, where it is turned into both orders.
    """
    spark = genes.sparkSession
    scratch = Scratch(spark, "norms")
    g, singles = coded(genes, scratch)
    path = scratch.last
    met = window_pairs(g, w).select("contig", "later", "earlier", "orientation").distinct()
    # a pair of one accession counts for both orders
    n = F.when(F.col("later") == F.col("earlier"), 2).otherwise(1)
    half = met.groupBy(F.least("later", "earlier").alias("a"), F.greatest("later", "earlier").alias("b")).agg(F.sum(n).alias("total"))
    with shuffles_freed(spark):
        half = scratch.write(half, "half")
    scratch.drop(path)
    ends = half.select("a", "total").unionByName(half.filter("a <> b").select(F.col("b").alias("a"), "total"))
    marg = ends.groupBy(F.col("a").alias("code")).agg(F.sum("total").alias("m"))
    with shuffles_freed(spark):
        s = scratch.write(singles.join(marg, "code").select("code", "accession", "instances", "contigs", "m"), "ends")
    # one row: the sum of all counts
    total = half.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("total")).otherwise(2 * F.col("total"))).alias("all_pairs"))
    x = half.join(s.toDF("a", *[f"{v}_p" for v in "kicm"]), "a").join(s.toDF("b", *[f"{v}_q" for v in "kicm"]), "b").join(F.broadcast(total))
    orders = F.when(F.col("a") == F.col("b"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    x = x.withColumn("turned", F.explode(orders))
    end = lambda v, p, q: F.when(F.col("turned"), F.col(f"{v}_{q}")).otherwise(F.col(f"{v}_{p}"))
    of = lambda k, p, q: [end("k", p, q).alias(k), *[end(v, p, q).alias(f"{u}_{k}") for u, v in zip("icgm", "iccm")]]
    return _norms(x.select("total", "all_pairs", *of("a", "p", "q"), *of("b", "q", "p")))


def grouped_frequencies(genes: DataFrame, groups: list[str]) -> DataFrame:
    """Per accession: ``instances, contigs`` and the distinct values of every grouping column, with their shares of the totals."""
    names = ["instances", "contigs", *groups]
    counts = [F.count("*")] + [F.count_distinct(c) for c in ("contig", *groups)]
    per = genes.groupBy("accession").agg(*[c.alias(n) for c, n in zip(counts, names)])
    # one row: the totals
    total = genes.agg(*[c.alias(f"_{n}") for c, n in zip(counts, names)])
    return per.join(F.broadcast(total)).select("accession", *names, *[(F.col(n) / F.col(f"_{n}")).alias(f"{n}_ratio") for n in names])


def frequencies(genes: DataFrame, group: str | None = None) -> DataFrame:
    """Per accession: ``instances, contigs`` (and ``groups``) with their shares of the totals."""
    aggs = [F.count("*").alias("instances"), F.count_distinct("contig").alias("contigs")] + ([F.count_distinct(group).alias("groups")] if group else [])
    totals = [F.count("*").alias("_instances"), F.count_distinct("contig").alias("_contigs")] + ([F.count_distinct(group).alias("_groups")] if group else [])
    per = genes.groupBy("accession").agg(*aggs).join(F.broadcast(genes.agg(*totals)))
    names = ["instances", "contigs"] + (["groups"] if group else [])
    return per.select("accession", *names, *[(F.col(n) / F.col(f"_{n}")).alias(f"{n}_ratio") for n in names])


def label_odds(genes: DataFrame, label: str, first, second) -> DataFrame:
    """Contigs per accession and label, their shares, and the ratio of the two shares (null if the second is 0)."""
    of = lambda v: F.count_distinct(F.when(F.col(label) == v, F.col("contig")))
    per = genes.groupBy("accession").agg(of(first).alias("contigs_first"), of(second).alias("contigs_second"))
    all_ = F.broadcast(genes.agg(of(first).alias("n_first"), of(second).alias("n_second")))
    x = per.join(all_).withColumn("ratio_first", F.col("contigs_first") / F.col("n_first")).withColumn("ratio_second", F.col("contigs_second") / F.col("n_second"))
    odds = F.when(F.col("ratio_second") > 0, F.col("ratio_first") / F.col("ratio_second"))
    return x.select("accession", "contigs_first", "contigs_second", "ratio_first", "ratio_second", odds.alias("odds"))


def exact_overlaps(genes: DataFrame) -> DataFrame:
    """Unordered pairs of different accessions on one (contig, start, stop): ``a, b, n`` with n distinct contigs."""
    g = genes.select("contig", "start", "stop", "accession").distinct()
    j = g.withColumnRenamed("accession", "a").join(g.withColumnRenamed("accession", "b"), ["contig", "start", "stop"]).filter("a < b")
    return j.groupBy("a", "b").agg(F.count_distinct("contig").alias("n"))


def instances_within(genes: DataFrame, a: str, b: str, w: int) -> DataFrame:
    """Rows of accession ``a`` or ``b`` that stand within ``w`` of the other one on a contig."""
    two = genes.filter(F.col("accession").isin(a, b))
    both = two.groupBy("contig").agg(F.count_distinct("accession").alias("k")).filter("k = 2").select("contig")
    two = two.join(both, "contig", "left_semi")
    p = window_pairs(two, w).filter(F.col("later") != F.col("earlier"))
    rows = p.select(F.col("r_i").alias("row")).unionByName(p.select(F.col("r_j").alias("row"))).distinct()
    return two.join(rows, "row", "left_semi")


def masked(scored: DataFrame, key: str, keep=None, drop=None) -> DataFrame:
    """Rows whose ``key`` is among ``keep`` and not among ``drop``; each is a list of values, a condition (column) or None."""
    condition = lambda x: x if isinstance(x, Column) else F.col(key).isin(x)
    if keep is not None:
        scored = scored.filter(condition(keep))
    return scored if drop is None else scored.filter(~condition(drop))


def top_pairs(scored: DataFrame, value: str, k: int, largest: bool = True, keys: tuple[str, str] = ("a", "b"), keep=(None, None), drop=(None, None),
    symmetric: bool = False, tail: bool = False) -> DataFrame:
    """The ``k`` largest (or smallest) rows by ``value``; ties go by the keys.

    ``keep`` and ``drop`` restrict each key, see `masked`. With ``symmetric`` (a, b) and (b, a) are the same and each pair is
    one row, a <= b. With ``tail`` the k rows of the other end follow; ``is_tail`` tells them apart, and a row of both ends is in both.
    """
    for key, some, none in zip(keys, keep, drop):
        scored = masked(scored, key, some, none)
    if symmetric:
        scored = scored.filter(F.col(keys[0]) <= F.col(keys[1]))
    end = lambda high: scored.orderBy(F.col(value).desc() if high else F.col(value).asc(), *keys).limit(k)
    if not tail:
        return end(largest)
    return end(largest).withColumn("is_tail", F.lit(False)).unionByName(end(not largest).withColumn("is_tail", F.lit(True)))


def greedy_matching(scored: DataFrame, value: str, k: int | None = None, keys: tuple[str, str] = ("a", "b"), max_rounds: int = 10_000) -> DataFrame:
    """One-to-one matching by descending value: a row is taken if neither of its ends was taken before.

    Rounds of mutual best rows give the same matching as the sequential walk, because a
    row that is best for both its ends cannot lose either. ``k`` keeps the best k.
    """
    scratch = Scratch(scored.sparkSession, "matching")
    a, b = keys
    rest = scratch.write(scored.select(a, b, value).filter(F.col(value).isNotNull()), "rest")
    out: DataFrame | None = None
    for _ in range(max_rounds):
        order = F.struct(-F.col(value), F.col(a), F.col(b))
        best_a = rest.groupBy(a).agg(F.min(order).alias("o_a"))
        best_b = rest.groupBy(b).agg(F.min(order).alias("o_b"))
        won = scratch.write(rest.join(best_a, a).join(best_b, b).filter((F.col("o_a") == order) & (F.col("o_b") == order)).select(a, b, value), "won")
        if won.isEmpty():
            break
        out = won if out is None else out.unionByName(won)
        rest = scratch.write(rest.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti").select(a, b, value), "rest")
    else:
        raise RuntimeError("matching did not settle")
    out = scored.select(a, b, value).limit(0) if out is None else out
    return out if k is None else top_pairs(out, value, k, keys=keys)
