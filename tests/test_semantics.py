"""Decisions, invariants, and brute-force comparisons, mostly under one hot key."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window as W, functions as F

from strandline import scale
from strandline.functions import iupac, seq as S
from strandline.operators import calls as C, cnv as B, consensus as N, evidence as E, intervals as I, jobs as J, kmers as K, placement as P, reads as R, runs as U, sorting as O, text as X
from strandline.plans import registry
from strandline.plans.catalog import Tables
from strandline.sources import files as L, formats as M
from strandline.streaming import totals as T

FOLDER = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- scale helpers: small slices give the same values as plain windows ----------------


def test_carry_last_matches_window(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 else "k", i * rng.choice([1, 1, 9]) * 100 + i, rng.choice([None, None, None, "z", "b", "q"])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, o long, v string")
    want = df.withColumn("c", F.last("v", True).over(W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, -1)))
    key = lambda df: sorted((r.k, r.o, str(r.v), str(r.c)) for r in df.collect())
    assert key(scale.carry_last(df, ["k"], "o", "v", "c", fan=64)) == key(want)


def test_rank_and_running_sum_match_windows(spark):
    data = [("hot" if i % 3 == 0 else f"k{i % 7}", i, i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("o")))
    assert rows(scale.rank_in_group(df, ["k"], "o", width=16).select("k", "o", "v", "rn")) == rows(want)
    want = df.withColumn("s", F.sum("v").over(W.orderBy("o")))
    assert rows(scale.running_sum(df, "o", F.col("v"), "s", 16).select("k", "o", "v", "s")) == rows(want)
    want = df.withColumn("s", F.sum("v").over(W.partitionBy("k").orderBy("o")))
    assert rows(scale.running_sum(df, "o", F.col("v"), "s", 16, keys=("k",)).select("k", "o", "v", "s")) == rows(want)


def test_first_row_keeps_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert rows(scale.first_row(df, ["k"], "o").select("k", "v")) == [("a", "y"), ("b", "z")]
    assert rows(scale.first_row(df, ["k"], "o", last=True).select("k", "v")) == [("a", "x"), ("b", "z")]


# -- intervals ---------------------------------------------------------------------------


@pytest.mark.parametrize("bin_size", [1, 7, 64])
def test_interval_semi_and_anti_match_brute_force(spark, bin_size):
    rnd = random.Random(bin_size)
    points = [("c1", rnd.randrange(400)) for _ in range(12)] + [("c1", 200)] * 50 + [("c2", 5)]
    spans = [(i, rnd.choice(["c1", "c2", "c3"]), s, s + rnd.randrange(60)) for i in range(300) for s in [rnd.randrange(420)]]
    df = spark.createDataFrame(spans, "id int, chr string, start_pos long, end_pos long")
    p = spark.createDataFrame(points, "chr string, pos long")
    hit = {i for i, c, s, e in spans if any(c == pc and s <= x <= e for pc, x in points)}
    semi = {r.id for r in I.interval_semi(df, p, bin_size=bin_size).collect()}
    anti = {r.id for r in I.interval_semi(df, p, invert=True, bin_size=bin_size).collect()}
    assert semi == hit and anti == {s[0] for s in spans} - hit


def test_points_in_regions_match_brute_force(spark):
    rnd = random.Random(1)
    regions = [("c1", s, s + rnd.randrange(90)) for s in (rnd.randrange(500) for _ in range(40))] + [("c2", 1, 0)] + [("c1", 100, 140)] * 60
    pts = [(i, rnd.choice(["c1", "c2", "c3"]), rnd.randrange(620)) for i in range(400)]
    got = {r.id for r in I.in_regions(spark.createDataFrame(pts, "id int, chr string, pos long"),
                                      spark.createDataFrame(regions, "chr string, start_pos long, end_pos long"), margin=3, bin_size=32).collect()}
    assert got == {i for i, c, p in pts if any(c == rc and (e == 0 or s + 3 <= p <= e - 3) for rc, s, e in regions)}


def test_empty_point_list(spark, t):
    none = spark.createDataFrame([], "chr string, pos long")
    assert I.interval_semi(t.alignments, none).isEmpty()
    assert I.interval_semi(t.alignments, none, invert=True).count() == t.alignments.count()


def test_overlap_pairs_once(spark):
    rnd = random.Random(3)
    a = [(i, "c", s, s + rnd.randrange(200)) for i, s in enumerate(rnd.randrange(500) for _ in range(60))]
    b = [(i, "c", s, s + rnd.randrange(200)) for i, s in enumerate(rnd.randrange(500) for _ in range(60))]
    schema = "id int, chr string, start_pos long, end_pos long"
    got = I.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), bin_size=16).select("id", "id_r").collect()
    want = Counter((x[0], y[0]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])
    assert Counter(map(tuple, got)) == want


# -- calls -----------------------------------------------------------------------------


def test_repeated_positions_pair_one_to_one_in_order(spark):
    x = spark.createDataFrame([("x", "c", 1, 1, 0), ("x", "c", 1, 2, 1), ("x", "c", 1, 4, 2)], "sample string, chr string, pos int, mask int, ord long")
    y = spark.createDataFrame([("y", "c", 1, 1, 5), ("y", "c", 1, 8, 6)], "sample string, chr string, pos int, mask int, ord long")
    assert sorted(r.verdict for r in C.concordance_pairs(x, y).collect()) == ["no", "yes"]


def test_packed_counts_equal_pairs(spark):
    rng = random.Random(3)
    mask = lambda: rng.choice([None, *range(16), 1, 2, 15, 0])
    spot = lambda: rng.choice([-70, -1, 0, 63, 64, 65, *range(120, 140)])
    make = lambda names: spark.createDataFrame(
        [(rng.choice(names), rng.choice(["c", "d"]), spot(), mask(), i) for i in range(400)] + [(names[0], None, 5, 1, 400), (names[0], "c", None, 1, 401)],
        "sample string, chr string, pos long, mask int, ord long")
    x, y = make(["p", "q", "r"]), make(["q", "s"]).unionByName(spark.createDataFrame([("far", "z", 1, 1, 500)], "sample string, chr string, pos long, mask int, ord long"))
    x, y = x.checkpoint(), y.checkpoint()
    want = C.concordance_pairs(x, y, 50).groupBy("y_list", "x_list").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("yes", "no", "nocall_x", "nocall_y")])
    assert rows(C.pair_counts(x, y, 50)) == rows(want) and want.count() == 6
    assert rows(C.pair_counts(x.limit(0), y, 50)) == []


def test_matrix_counts_mirror(t):
    m = {(r.y_list, r.x_list): r for r in C.concordance_matrix(t.masked, t.masked).collect()}
    for (y, x), r in m.items():
        assert r.yes == m[x, y].yes and r.no == m[x, y].no and r.nocall_x == m[x, y].nocall_y
        assert x != y or (r.no == 0 and r.starred == 1)


def test_collapse_keeps_a_hot_position_in_one_row(spark):
    df = spark.createDataFrame([("c", 1, "A", "ACGT"[i % 4], i) for i in range(25)] + [("c", 2, "G", "T", 99)], "chr string, pos int, ref string, call string, ord long")
    got = rows(C.collapse_calls(df))
    assert [g[:2] for g in got] == [("c", 1), ("c", 2)]
    assert got[0][2] == "alleles " + "/".join("ACGT"[i % 4] for i in reversed(range(25))) + "; ref_allele A"


def test_masks(spark):
    df = spark.createDataFrame([("A",), ("AG",), ("N",), ("X",), ("r",), ("Z",)], "c string")
    assert [r[0] for r in df.select(iupac.mask("c")).collect()] == [1, 5, 15, 0, 5, None]
    assert [r[0] for r in df.select(iupac.call_class("c")).collect()] == ["hom", "het", "nocall", "nocall", "het", None]


# -- sequences -------------------------------------------------------------------------


def test_reverse_complement_is_an_involution(t):
    twice = t.reads.select("bases", S.revcomp(S.revcomp("bases")).alias("b"))
    assert twice.where("bases <> b").isEmpty()


def test_kmers_across_pieces(spark):
    text = "".join(random.Random(5).choice("acgt") for _ in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id int, seq string")
    got = {r.pos: r.kmer for r in K.explode_kmers(df, 9).collect()}
    assert got == {i: text[i:i + 9] for i in range(len(text) - 8)}
    chunks = K.chunk_sequences(df.select(F.lit("c").alias("chr"), "seq"), 100)
    assert {r.pos: r.kmer for r in K.all_kmers(chunks, 9, 100).collect()} == got


def test_substitutions(spark):
    df = spark.createDataFrame([("acg",), ("ang",), ("nnc",)], "mer string")
    got = defaultdict(set)
    for r in R.substitute_variants(df, 3).collect():
        got[r.mer].add((r.variant, r.err))
    assert got["acg"] == {("acg", -1)} | {("acg"[:i] + b + "acg"[i + 1:], i) for i in range(3) for b in "acgt" if b != "acg"[i]}
    assert got["ang"] == {(f"a{b}g", 1) for b in "acgt"} and "nnc" not in got


def test_colour_space(spark):
    df = spark.createDataFrame([(1, "T0123"), (2, "A.1"), (3, "T0x2")], "read_id int, colors string")
    assert rows(R.colorspace_decode(df).select("read_id", "bases")) == [(1, "TGAT"), (2, "AC")]


def test_select_reads_without_marked_letters(spark):
    df = spark.createDataFrame([("acgt", "acgT"), ("acnt", "acgT"), ("acgt", "acgt")], "bases string, copy string")
    assert R.select_reads(df, True, True).count() == 1


# -- text, sorting -----------------------------------------------------------------------


def test_window_edges(spark):
    df = spark.createDataFrame([(999,), (1000,), (1001,), (2000,)], "pos int")
    assert rows(O.window_filter(df, 1, 1000)) == [(1000,), (1001,)]
    assert rows(O.window_filter(df, 1, 1000, compat=True)) == [(1001,)]


def test_stats_table_keeps_the_last_index(spark):
    df = spark.createDataFrame([("a_000=1\tb_002=5",), ("a_2=3",)], "line string")
    assert rows(X.pivot_stats(df, ["a", "b"])) == [(0, 1, 0), (1, 0, 0), (2, 3, 5)]
    assert rows(X.pivot_stats(df, ["a", "b"], compat=True)) == [(0, 1, 0), (1, 0, 0)]


def test_sorted_outputs(t):
    got = [(r.chr, r.start_pos, r.read_id) for r in O.sort_by_position(t.alignments, then=("read_id",)).collect()]
    assert got == sorted(got)
    lines = [r.line for r in O.sort_bench(t.documents).collect()]
    assert lines == sorted(lines, key=lambda s: s.encode())


def test_batches_of_long_reads(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([10, 500, 20, 500, 500, 30, 500])], "ord long, n_bases int")
    assert rows(X.batch(df, 2, min_length=400).select("ord", "batch")) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)]


# -- consensus, runs -----------------------------------------------------------------------


def test_consensus_on_a_deep_position(spark):
    rnd = random.Random(2)
    data = [("e", 1 if i % 3 else i, rnd.choice("ACGTN"), rnd.randrange(40), i) for i in range(600)]
    got = {(r.exon, r.pos): tuple(r)[2:] for r in N.consensus_by_quality(spark.createDataFrame(data, "exon string, pos int, base string, qual int, ord long")).collect()}
    groups = defaultdict(list)
    for e, p, b, q, o in data:
        groups[e, p].append((q, o, b))
    bits = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 15}
    for key, g in groups.items():
        left = sorted(g)[1:]
        call = 0
        for _, _, b in left:
            call |= bits[b]
        assert got[key] == ("XACMGRSVTWYHKDBN"[call], *[sum(q for q, _, b in left if b == x) for x in "ACGT"])


def test_undisputed_counts_reference_only_votes(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 3, 0, 0, 1), (0, 0, 0, 0, 2)], "a int, c int, g int, t int, ref_mask int")
    assert tuple(N.consensus_stats(df).first()) == (3, 2, 2, 1)


def test_runs_of_one_alignment(spark):
    ref = "acagaacagaaccacagattttcacagacccacaga"
    qry = ref.replace("aga", "gga", 2)
    df = spark.createDataFrame([("q", "c", "P", 1, 1, ref, qry), ("r", "c", "P", 1, 1, ref, ref), ("z", "c", "P", 1, 1, ref, qry), ("z", "c", "P", 1, 1, ref, qry)],
                               "query string, chr string, strand string, pos_r int, pos_q int, bp_r string, bp_q string")
    got = rows(U.mismatch_runs(df, 0, 2).select("query", "edit", "n", "span", "positions"))
    spots = [i for i in range(len(ref)) if ref[i] != qry[i]]
    assert got == [("q", "a}g", len(spots), spots[-1] - spots[0], " ".join(map(str, spots)))]
    assert tuple(U.run_summary(df, 0, 2).first()) == (1, 1, 1, 0)


def test_grid_lines(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in (0, 1, 4, 5, 6, 9, 10)], "x double, y double")
    assert rows(U.snap_to_grid(df, 1, 1).select("x", "grid_x")) == [(0, 0), (1, 0), (4, 0), (5, 0), (6, 6), (9, 6), (10, 6)]


def test_edit_clusters(spark):
    ref = "c" * 30 + "gcgcgcg" + "c" * 60
    df = spark.createDataFrame([("q", ref.replace("g", "a"), ref), ("n", ref[:-1] + "t", ref)], "query string, bp_q string, bp_r string")
    got = U.cluster_edits(df, 0.05, 3).collect()
    assert [(r.query, r.edit, r.control, r.n_clusters, r.positions) for r in got] == [("q", "ag", 0, 1, "30 32 34 36")]


def test_running_sum_of_sparse_ids(spark):
    """Ids far apart make as many slices as rows; no window may gather them."""
    ids = [i * 10 ** 9 for i in range(3000)] + [2 ** 62, -5]
    df = spark.createDataFrame([(i, 1 + i % 3) for i in ids], "ord long, v long")
    got = {r.ord: r.s for r in scale.running_sum(df, "ord", F.col("v"), "s").collect()}
    total, want = 0, {}
    for i in sorted(ids):
        total += 1 + i % 3
        want[i] = total
    assert got == want
    batches = X.batch(df, 100, "ord").groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in batches) == [(b, 100) for b in range(1, 31)] + [(31, 2)]


def test_long_spans_join_without_fan_out(spark):
    rng = random.Random(3)
    spans = lambda n, most: [(f"c{rng.randrange(2)}", i, a := rng.randrange(3_000_000), a + rng.choice([0, 5, 3000, rng.randrange(most)])) for i in range(n)]
    a, b = spans(120, 2_500_000), spans(120, 2_500_000)
    b += [(c, 1000 + i, s, e) for c, i, s, e in a[:5]]
    make = lambda x: spark.createDataFrame(x, "chr string, id int, start_pos long, end_pos long")
    want = Counter((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    got = Counter((r.id, r.id_r) for r in I.interval_join(make(a), make(b), bin_size=100).collect())
    assert got == want
    nodes = make(a).select(F.size(I._span_nodes(I._bin("start_pos", 100), I._bin("end_pos", 100))).alias("n")).agg(F.max("n")).first()[0]
    assert nodes < 3 * 2 * I.FAN


def brute_clusters(positions, ordinals, p, pvalue, least):
    """Members and number of clusters by testing every stretch."""
    from math import comb
    tail = lambda n, k: max(0.0, 1 - sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k)))
    good = [(i, j) for i in range(len(positions)) for j in range(i + least - 1, len(positions))
            if ordinals[j] - ordinals[i] == j - i and tail(positions[j] - positions[i] + 1, j - i + 1) < pvalue]
    members = {x for i, j in good for x in range(i, j + 1)}
    starts = [x for x in members if x - 1 not in members or not any(i < x <= j for i, j in good)]
    return [positions[x] for x in sorted(members)], len(starts)


def test_edit_clusters_against_brute_force(spark):
    rng = random.Random(12)
    made = []
    for k in range(40):
        ref = "".join(rng.choice("acgt") for _ in range(18))
        read = "".join(("a" if c == "g" and rng.random() < 0.8 else rng.choice("acgt-") if rng.random() < 0.1 else c) for c in ref)
        ref = "".join("-" if rng.random() < 0.1 and a != "-" else c for c, a in zip(ref, read))
        made.append((f"q{k}", read, ref))
    got = {(r.query, r.edit): (r.positions, r.n_clusters) for r in U.cluster_edits(spark.createDataFrame(made, "query string, bp_q string, bp_r string"), 0.05, 2).collect()}
    want = {}
    for name, q, r in made:
        address, mm = 0, []
        for a, b in zip(q, r):
            if a != b and "-" not in (a, b):
                mm.append((address, a + b))
            address += b != "-"
        counted = [e for _, e in mm if e in ("ag", "ga", "tc", "ct")]
        for e in ("ag", "ga", "tc", "ct"):
            own = [i for i, (_, x) in enumerate(mm) if x == e]
            p = (len(counted) - len(own)) / (3 * len(q))
            members, n = brute_clusters([mm[i][0] for i in own], own, p, 0.05, 2)
            if n:
                want[(name, e)] = (" ".join(map(str, members)), n)
    assert got == want and len(want) > 3


def test_kmers_do_not_depend_on_chunks(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("acgt") if rng.random() < 0.9 else "n" * rng.randint(1, 40) for _ in range(300))
    df = spark.createDataFrame([("c", "nnn" + seq), ("n", "nnnnnn"), ("d", "n" * 30 + "acgt" * 5)], "chr string, seq string")
    got = [{tuple(r) for r in K.all_kmers(K.chunk_sequences(df, size), 9, size).collect()} for size in (10, 64, 1000)]
    assert got[0] == got[1] == got[2] and any(k[2] == "acgtacgta" and k[0] == "d" for k in got[0])


def test_gapped_kmers_do_not_depend_on_chunks(spark):
    rng = random.Random(2)
    seq = "nnn" + "".join(rng.choice("acgt") if rng.random() < 0.9 else "n" * rng.randint(1, 40) for _ in range(300))
    texts = {"c": seq, "n": "nnnnnn", "s": "acgtacgta", "d": "n" * 30 + "acgt" * 5}
    want = set()
    for chr, text in texts.items():
        bases = text.strip("n")
        if not bases:
            continue
        full = bases[0] * (len(text) - len(text.lstrip("n")))
        for c in text[len(full):]:
            full += c if c != "n" else full[-1]
        want |= {(chr, p * 3 + g - 2, full[p:p + 4] + full[p + 4 + g:p + 8 + g]) for p in range(len(full)) for g in (2, 3, 4) if p + 8 + g <= len(full)}
    df = spark.createDataFrame(list(texts.items()), "chr string, seq string")
    for size in (7, 64, 1000):
        assert {tuple(r) for r in K.all_gapped_kmers(K.chunk_sequences(df, size), 8, 2, 4, 4, size).collect()} == want
    assert {tuple(r) for r in K.all_gapped_kmers(df, 8, 2, 4, 4).collect()} == want


def test_gapped_kmers_stop_at_a_hole(spark):
    chunks = spark.createDataFrame([("c", 0, "acgta"), ("c", 2, "ccccc")], "chr string, chunk_no long, seq string")
    assert rows(K.all_gapped_kmers(chunks, 4, 1, 1, 2, 5)) == [("c", 0, "acta"), ("c", 10, "cccc")]


def test_reference_slices_reach_over_chunks(spark):
    seq = "".join(random.Random(2).choice("acgt") for _ in range(95))
    chunks = K.chunk_sequences(spark.createDataFrame([("c", seq)], "chr string, seq string"), 20)
    df = spark.createDataFrame([("c", i) for i in range(95)], "chr string, pos long")
    for r in K.reference_slice(df, chunks, 20, F.col("pos"), F.lit(20), "s").collect():
        assert r.s == seq[r.pos:r.pos + 20]
    with pytest.raises(Exception, match="longer than a chunk"):
        K.reference_slice(df, chunks, 20, F.col("pos"), F.lit(21), "s").collect()


def test_header_keeps_its_order(spark):
    lines = ["#: z", "# field b", "# field a", "#.", "m", "#body", "a"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string").repartition(3)
    assert [r.line for r in O.sort_keep_header(df).collect()] == ["#: z", "# field b", "# field a", "#.", "#body", "a", "m"]


def test_checksums_are_hashed_flat(spark):
    import hashlib
    df = spark.createDataFrame([("j", 2, "bb"), ("j", 1, "aa"), ("k", 1, "cc")], "job string, ord int, checksum string")
    got = {r.job: r.checksum for r in X.checksum_of_checksums(df, "job", "ord").collect()}
    assert got == {"j": hashlib.md5(b"aabb").hexdigest(), "k": hashlib.md5(b"cc").hexdigest(), None: hashlib.md5(b"aabbcc").hexdigest()}


def test_equal_regions_stay_apart(spark):
    chunks = K.chunk_sequences(spark.createDataFrame([("c", "acgtacgtac")], "chr string, seq string"), 3)
    df = spark.createDataFrame([("c", 1, 4, "+", "r")] * 2, "chr string, start_pos int, end_pos int, strand string, name string")
    assert [r.seq for r in I.context_slice(df, chunks, 3).collect()] == ["acgt", "acgt"]


def test_null_cells_keep_their_place(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 7), (None, "x", 8)], "a long, b string, c long")
    M.write_table(df, str(tmp_path / "t"), "#: t-0.1/text")
    assert sorted(map(tuple, M.read_table(spark, str(tmp_path / "t")).collect()), key=lambda r: r[2]) == [(1, None, 7), (None, "x", 8)]


def test_segments_are_stable(spark):
    data = [("chr1", b, 50, 50 if b < 40 else 150) for b in range(80)]
    got = rows(B.cnv_segment(spark.createDataFrame(data, "chr string, bin long, normal long, tumor long"), width=16))
    assert got == [("chr1", 0, 39, 2000, 2000), ("chr1", 40, 79, 2000, 6000)]
    report = B.cnv_report(spark.createDataFrame(got, "chr string, first_bin long, last_bin long, normal long, tumor long")).collect()
    assert [r.log2_ratio for r in sorted(report)] == pytest.approx([-1.0, 0.58472], abs=1e-4)


# -- evidence, jobs ------------------------------------------------------------------------


def test_metadata_inputs_clash(spark):
    docs = ['{"chromosomes":["a"],"match_num":1,"b":"x"}', '{"chromosomes":["a","c"],"match_num":10,"b":"y"}', '{"chromosomes":["c"],"match_num":100,"b":"x"}']
    df = spark.createDataFrame(list(enumerate(docs)), "ord long, json string")
    got = {(r.key, r.kind, r.value) for r in E.merge_metadata(df).collect()}
    assert got == {("chromosomes", "array", "a"), ("chromosomes", "array", "c"), ("match_num", "number", "101"), ("b", "string", "x")}


def test_unpaired_sample_is_an_error(spark):
    a = spark.createDataFrame([("x", 1)], "name string, n int")
    with pytest.raises(Exception, match="unpaired chunk"):
        E.pair_samples(a, a.withColumn("name", F.lit("y"))).collect()


def test_lineage_visits_once_in_cycles(spark):
    jobs = spark.createDataFrame([(0, "k0", "k0", ""), (1, "k0", "k1", ""), (2, "k1", "k0", ""), (3, "k2", "k3", "REF=" + "a" * 32), (4, "x", "a" * 32, "")],
                                 "id long, inputkey string, outputkey string, knobs string")
    roots = lambda *ids: jobs.where(F.col("id").isin(*ids))
    assert rows(J.lineage(jobs, roots(2), "up")) == [(0, 2), (1, 1), (2, 0)]
    assert rows(J.lineage(jobs, roots(0), "down")) == [(0, 0), (1, 1), (2, 2)]
    assert rows(J.lineage(jobs, roots(4), "down")) == [(3, 1), (4, 0)]


def test_recovery_levels(spark):
    jobs = spark.createDataFrame([(1, "ok", "a", 1), (2, "a", "b", 1), (5, "ok", "b", 1), (3, "b", "c", 0)], "id long, inputkey string, outputkey string, success int")
    broken = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r.key: (r.level, r.job) for r in J.recovery_plan(jobs, broken).collect()}
    assert got == {"a": (0, 1), "b": (0, 5), "c": (None, None)}


# -- files, streams ----------------------------------------------------------------------------


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(5000).selectExpr("concat('line ', id)").coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = L.numbered_text(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    assert sorted((r.line_no, r.line) for r in got) == [(i + 1, f"line {i}") for i in range(5000)]


def test_fasta_gaps_advance_the_position(spark):
    text = [">one x", "acgtNN", "NNac", "gt", ">two", "MRac"]
    df = spark.createDataFrame([("f", i + 1, s) for i, s in enumerate(text)], "file string, line_no long, line string")
    got = rows(M.parse_fasta(df, chunk=5, width=2).select("name", "pos", "seq"))
    assert got == [("one", 0, "acgt"), ("one", 8, "ac"), ("one", 10, "gt"), ("two", 2, "ac")]


def test_recompress_takes_finished_files_along(spark, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).selectExpr("cast(id as string)").coalesce(1).write.text(src)
    spark.range(2).selectExpr("cast(id as string)").coalesce(1).write.mode("append").option("compression", "gzip").text(src)
    L.recompress(spark, src, dst)
    assert L.read_files(spark, dst, "*.gz").count() == 5


def test_late_jobs_lose_final_hours(spark, tmp_path):
    from pyspark.sql import types as Y
    schema = Y.StructType([Y.StructField("starttime", Y.TimestampType()), Y.StructField("elapsed_s", Y.LongType()), Y.StructField("nodes", Y.LongType())])
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for times in (["2024-01-01 00:30:00"], ["2024-02-01 00:00:00"], ["2024-01-01 00:10:00"], ["2024-03-01 00:00:00"]):
        spark.createDataFrame([(x,) for x in times], "s string").selectExpr("cast(s as timestamp) as starttime", "3600L as elapsed_s", "2L as nodes").coalesce(1).write.mode("append").parquet(src)
        T.run_available(T.hourly_usage(spark.readStream.schema(schema).parquet(src)), out, state)
    got = [(str(r.hour), r.node_seconds) for r in spark.read.parquet(out).orderBy("hour").collect()]
    assert got == [("2024-01-01 00:00:00", 3600), ("2024-01-01 01:00:00", 3600), ("2024-02-01 00:00:00", 7200)]


def test_slices_stop_at_absent_chunks(spark):
    chunks = spark.createDataFrame([("c", 0, "aaaa"), ("c", 2, "gggg"), ("c", 3, "tt")], "chr string, chunk_no long, seq string")
    ask = lambda lo, n: spark.createDataFrame([("c", lo)], "chr string, pos long").transform(
        lambda d: K.reference_slice(d, chunks, 4, F.col("pos"), F.lit(n), "s")).collect()
    assert [r.s for r in ask(0, 4)] == ["aaaa"] and [r.s for r in ask(2, 4)] == ["aa"]
    assert ask(4, 4) == [] and [r.s for r in ask(8, 4)] == ["gggg"] and [r.s for r in ask(10, 4)] == ["ggtt"] and [r.s for r in ask(13, 4)] == ["t"]
    with pytest.raises(Exception, match="before the reference"):
        ask(-1, 3)


def test_kmers_ahead_of_a_hit(spark):
    text = "acgtaccgtagcatcgatgcatgacatcgatcagc"
    chunks = K.chunk_sequences(spark.createDataFrame([("c", text)], "chr string, seq string"), 5)
    got = {(r.pos, r.kmer, r.ahead) for r in K.all_kmers(chunks, 4, 5, ahead=9).collect()}
    assert got == {(i, text[i:i + 4], text[i + 4:i + 13]) for i in range(len(text) - 3)}


def test_large_index_is_filtered_and_shuffled(spark, monkeypatch):
    """Without broadcast: distinct mers are widened, filtered by the bit table and joined; the same hits."""


    from strandline import scale
    rng = random.Random(2)
    ref = "".join(rng.choice("acgt") for _ in range(3000))
    reads = [(i, ref[p:p + 8] if i % 2 else ref[p:p + 3] + rng.choice("acgtn") + ref[p + 4:p + 8]) for i, p in enumerate(rng.sample(range(2900), 60))]
    reads += [(100, None), (101, "acg"), (102, "nnacgtac"), (103, reads[1][1].upper())]
    df = spark.createDataFrame(reads, "sample long, mer string")
    kmers = K.all_kmers(K.chunk_sequences(spark.createDataFrame([("c", ref)], "chr string, seq string"), 100), 8, 100)
    near = lambda a, b: len(a or "") == 8 and sum(x != y for x, y in zip(a.lower(), b)) <= 1
    want = sorted((i, p) for i, m in reads for p in range(len(ref) - 7) if near(m, ref[p:p + 8]))
    hits = lambda: sorted((r.sample, r.pos) for r in K.kmer_join(df, kmers, 8).collect())
    assert hits() == want
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert hits() == want
    monkeypatch.setattr(K, "FILTER_BITS", 10)
    assert hits() == want


def test_split_reads_with_two_changes(spark):
    rng = random.Random(4)
    exon = "".join(rng.choice("acgt") for _ in range(90))  # its first 30 starts count twice
    two = exon + exon
    make = lambda a, b: two[a:a + 6] + two[a + 20:a + 26] + two[b:b + 6] + two[b + 21:b + 27]
    change = lambda s, *at: "".join("acgt"["acgt".index(c) ^ 1] if i in at else c for i, c in enumerate(s))
    reads = [(1, make(33, 40)), (2, change(make(35, 50), 2)), (3, change(make(39, 60), 1, 20)), (4, change(make(39, 60), 1, 5)), (5, change(make(39, 60), 1, 5, 20)),
             (6, make(30, 35).replace("a", ".")), (7, "n" + make(41, 44)[1:]), (8, "acg")]
    df = spark.createDataFrame(reads, "read_id long, bases string")
    exons = spark.createDataFrame([("e", exon)], "exon string, seq string")
    got = {r.read_id: (r["class"], r.mm) for r in P.place_split_reads(df, exons, 2).collect()}
    assert got[1] == ("U", 0) and got[2] == ("U", 1) and got[3] == ("U", 2) and got[4] == ("U", 2) and got[5] == ("0", None)
    assert got[7] == ("U", 1) and got[8] == ("0", None) and 6 not in got
    assert {r.read_id: r["class"] for r in P.place_split_reads(df, exons, 1).collect()}[3] == "0"


def test_recompress_keeps_streams_and_codecs_apart(spark, tmp_path):
    import bz2
    import glob
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    for folder, line in (("a", "one"), ("b", "two")):
        (tmp_path / "src" / folder).mkdir(parents=True)
        (tmp_path / "src" / folder / "r.txt").write_text(f"{line}\n")
    L.recompress(spark, src, dst, "bzip2")
    found = {p.split("stream=")[1].split("/")[0]: bz2.open(p).read() for p in glob.glob(f"{dst}/**/*.bz2", recursive=True)}
    assert found == {"a": b"one\n", "b": b"two\n"}
    assert not glob.glob(f"{dst}/**/*.txt", recursive=True)


@pytest.mark.parametrize("cells", [1, 7, 40])
def test_grid_lines_by_doubling(spark, cells):
    rng = random.Random(cells)
    dense = [float(rng.choice([rng.random() * 3, rng.randint(0, 50), 50 + rng.gauss(0, 0.01)])) for _ in range(400)]
    df = spark.createDataFrame([(v, float(i % 5)) for i, v in enumerate(dense)] + [(None, 1.0)], "x double, y double").repartition(5)
    lo, hi = min(dense), max(dense)
    step, lines = (hi - lo) / cells / 2, []
    for v in sorted(dense):
        if not lines or v > lines[-1] + step:
            lines.append(v)
    want = sorted((v, max(a for a in lines if a <= v)) for v in dense)
    got = U.snap_to_grid(df, cells, 2).select("x", "grid_x").where("x is not null").collect()
    assert sorted((r.x, r.grid_x) for r in got) == want
