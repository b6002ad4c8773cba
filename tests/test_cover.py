import random

from seqsys.operators.annot import anchor_cover


def one_at_a_time(rows):
    rows, out = list(rows), []
    while rows:
        by = {}
        for r in rows:
            by.setdefault(r[3], []).append(r)
        stats = {a: (len({r[0] for r in v}), len(v), min(r[0] for r in v), min(r[1] for r in v)) for a, v in by.items()}
        if max(x[0] for x in stats.values()) > 1:
            pick = min(stats, key=lambda a: (-stats[a][0], -stats[a][1], stats[a][3], a))
        else:
            pick = min(stats, key=lambda a: (stats[a][2], stats[a][3], a))
        out.append(pick)
        gone = {r[0] for r in by[pick]}
        rows = [r for r in rows if r[0] not in gone]
    return out


def test_cover_goes_on_until_every_contig_is_covered(spark):
    rng = random.Random(5)
    rows = [(f"c{i:03}", 10 * k, 10 * k + 5, f"own{i}" if i >= 60 else f"a{int(rng.expovariate(0.1))}", "S") for i in range(290) for k in range(2)]
    genes = spark.createDataFrame(rows, "contig string, start int, stop int, accession string, source string")
    got = [r.accession for r in anchor_cover(genes).orderBy("position").collect()]
    assert len(got) > 200 and got == one_at_a_time(rows)
    given = anchor_cover(genes, start_genes=["own70", "own71"], max_rounds=20).orderBy("position").collect()
    assert [r.position for r in given] == list(range(20)) and [r.accession for r in given][:2] == ["own70", "own71"]
