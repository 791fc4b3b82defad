"""What grows with the input: bytes moved and work per letter, with results as by brute force."""

import random
import time
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from strandline.functions import seq as Q
from strandline.operators import imaging as M, reads as R, runs as U, storage as S, text as X
from strandline.plans import registry
from strandline.plans.catalog import QUERIES, Tables
from strandline.scale import running_sums
from strandline.sources import files as L

registry.load()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pixels_are_packed_before_they_are_moved(spark):
    rnd = random.Random(7)
    for kind, low, high in (("int", -2**31, 2**31 - 1), ("tinyint", -128, 127), ("bigint", -2**63, 2**63 - 1), ("int", 0, 255), ("double", 0, 9)):
        for width in (1, 20, 33, 70) if kind == "int" else (20, 33):
            made = {i: [rnd.choice([low, high, rnd.randint(low, high), None]) for _ in range(width * 4 - i % 3)] for i in range(4)}
            pixels = [(i, j, float(v) if kind == "double" and v is not None else v) for i, vs in made.items() for j, v in enumerate(vs)]
            rnd.shuffle(pixels)
            rows = M.image_rows(spark.createDataFrame(pixels, f"image long, idx int, value {kind}"), width)
            want = {}
            for i, vs in made.items():
                lines = [vs[a:a + width] for a in range(0, len(vs), width)]
                for j, line in enumerate(lines):
                    want[i, j] = (line, lines[j - 1] if j else None, lines[j + 1] if j + 1 < len(lines) else None)
            assert {(r.image, r.row): (r.v, r.up, r.down) for r in rows.collect()} == want
            assert ("collect_list(struct(idx" in _plan(rows)) == (kind == "double")


def test_blocks_of_a_line_are_not_moved(spark):
    md5 = lambda i: f"{i:032x}"
    lines = [(1, f"./a {md5(1)}+5 {md5(2)} {md5(3)}+7+Kx 0:9:x.txt b.txt"), (1, f"./a {md5(4)}-1 {md5(5)}+2 3:0:y"), (None, "./b"), (2, None), (3, f"./c 0:4:z {md5(6)}+9")]
    blocks = S.parse_manifests(spark.createDataFrame(lines, "manifest int, line string"))[1]
    got = {(r.manifest, r.stream, r.i, r.md5, r.size, r.hints, r.first) for r in blocks.collect()}
    assert got == {(1, "./a", 0, md5(1), 5, "", 0), (1, "./a", 1, md5(2), None, "", 5), (1, "./a", 2, md5(3), 7, "+Kx", 5),
                   (1, "./a", 0, md5(4), S.BLOCK - 1, "", 0), (1, "./a", 1, md5(5), 2, "", S.BLOCK - 1), (3, "./c", 1, md5(6), 9, "", 0)}
    assert "Window" not in _plan(blocks) and "Repartition" not in _plan(blocks)


def test_files_meet_blocks_once(spark):
    rnd = random.Random(11)
    files, blocks = [("m", "./s0", "long", 5, 1 << 50)], []
    for s in range(6):
        first = 0
        for i in range(40):
            size = rnd.choice([None, 0, 1, 9, 500])
            blocks.append((None if s == 5 else "m", f"./s{s}", i, f"b{s}-{i}", size, first))
            first += size or 0
        files += [(None if s == 5 else "m", f"./s{s}", f"f{j}", p := rnd.randint(0, first), rnd.choice([None, 0, 1, rnd.randint(1, first), 2 * first])) for j in range(12)]
    ranges = S.file_block_ranges(spark.createDataFrame(files, "manifest string, stream string, file string, pos long, size long"),
                                 spark.createDataFrame(blocks, "manifest string, stream string, i int, md5 string, size long, first long"))
    want = [(f[0], f[1], f[2], b[2], b[3], max(f[3], b[5]) - b[5], min(f[3] + f[4], b[5] + b[4]) - max(f[3], b[5])) for f in files for b in blocks
            if f[:2] == b[:2] and f[4] and b[4] and f[3] < b[5] + b[4] and b[5] < f[3] + f[4]]
    assert sorted(map(str, (tuple(r) for r in ranges.collect()))) == sorted(map(str, want))
    assert _plan(ranges).count("Join Inner") == 1


def test_numbered_lines_and_their_totals_are_moved_once(spark, tmp_path):
    (tmp_path / "a").write_text("\n".join(map(str, range(500))))
    assert "strategy=broadcast" in _plan(L.numbered_text(spark, str(tmp_path)))
    rows = [(k, i, (i * 7 + (k or 0)) % 11) for k in (0, 1, None) for i in range(0, 8 if k == 1 else 100, 1 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    got = running_sums(df, "i", {"s": F.col("v")}, ("k",), 16, 32, counted=True)
    want = {(k, i): sum(v for kk, j, v in rows if kk == k and j <= i) for k, i, _ in rows}
    assert {(r.k, r.i): r.s for r in got.collect()} == want


def test_long_islands_of_edits(spark):
    # Every letter of a stretch of 700 is edited: widest stretch first, where all were tried before, each over all its members.
    ref, query = "c" * 300 + "a" * 700 + "c" * 300, "c" * 300 + "g" * 700 + "c" * 300
    df = spark.createDataFrame([("q", query, ref), ("r", "c--ac", "c-gga")], "query string, bp_q string, bp_r string")
    start = time.time()
    got = U.cluster_edits(df, 0.05, 3).collect()
    assert [(r.query, r.edit, r.n_clusters, r.n_members, r.n_edits) for r in got] == [("q", "ga", 1, 700, 700)] and time.time() - start < 60


def test_letters_of_documents_are_made_once(spark):
    plan = _plan(QUERIES["cluster_edits"](Tables(spark, "/root/testdata/sf0.001")))
    assert plan.count("regexp_replace") == 1


def test_mers_and_their_complements_are_counted_once(spark):
    rnd = random.Random(2)
    arms = [tuple(rnd.choice(["acgt", "aacc", "ggtt", "nacg", "", None]) for _ in range(2)) for _ in range(80)]
    got = R.kmer_coincidence(spark.createDataFrame(arms, "arm0 string, arm1 string"), 30)
    rc = lambda m: m and m[::-1].translate(str.maketrans("acgt", "tgca"))
    n = Counter(x for a in arms for m in a for x in (m, rc(m)))
    assert {(r.mer, r.n, r.overflow) for r in got.collect()} == {(m, min(c, 30), max(c - 30, 0)) for m, c in n.items()}
    assert "least(" in _plan(got) and "Generate explode(array(least" in _plan(got)


def test_codes_are_read_from_a_table(spark):
    mers = ["".join(p) for p in product("acgt", repeat=3)] + ["acgtacgtacgtac", "tttttttttttttt", "a", None]
    for k in (1, 3, 14):
        own = [m for m in mers if m is None or len(m) == k]
        df = spark.createDataFrame([(m,) for m in own], "mer string").select("mer", Q.kmer_text(Q.kmer_code("mer"), k).alias("back"))
        assert all(r.mer == r.back for r in df.collect()) and "conv(cast" not in _plan(df)
    seqs = spark.createDataFrame([(1, "acgtnnacgtaccgt"), (2, "nnacgtacgtaa"), (3, "acg"), (4, None)], "doc_id long, seq string")
    plan = R.sequence_encode(seqs)
    assert {(r.doc_id, r.offset, r.code) for r in plan.where("doc_id = 2").collect()} == {
        (2, i, int("aaacgtacgtaa"[i:i + 8].translate(str.maketrans("acgt", "0123")), 4)) for i in range(5)}
    assert "lower(kmer" not in _plan(plan)


def test_checksums_of_all_are_read_as_bytes(spark):
    import hashlib
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    rows = [(g, o, c) for g in (3, 1, None) for o, c in ((2, md5(f"{g}")), (1, "0aF" if g == 1 else md5("b")), (3, None), (4, "é" if g is None else "00"), (5, "\n" if g is None else ""))]
    schema = "grp int, ord int, checksum string"
    df = X.checksum_of_checksums(spark.createDataFrame(rows, schema), "grp", "ord")
    text = {g: "".join(c or "" for _, c in sorted(((o, c) for gg, o, c in rows if gg == g), key=lambda x: x[0])) for g in (3, 1, None)}
    want = [md5(text[g]) for g in (3, 1, None)] + [md5(text[None] + text[1] + text[3])]
    assert sorted(r.checksum for r in df.collect()) == sorted(want)
    assert "unhex" in _plan(df)
    assert [tuple(r) for r in X.checksum_of_checksums(spark.createDataFrame([], schema), "grp", "ord").collect()] == [(None, md5(""))]
