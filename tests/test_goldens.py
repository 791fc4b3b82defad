"""Published example inputs with known results."""

import pytest

from strandline.operators import kmers as K, placement as P, reads as R, sorting as O

# Two reads of four 12-mers and a genome in 12-letter tiles.
READS = ["tgctgcagcagc cacagagatata tagttagttagt aaaaaaaaatgc", "taaaaaaaaaat ccccccccccct gggggggggggt agagagagagag"]
GENOME = ("tgctgcagcagc tcacagagatat actagttagtta gtaaaaaaaaaa tgctgcagcagc cacagagatata tagttagttagt aaaaaaaaaaat "
          "cccccccccccc gggggggggggg gg").split()
CASES = {
    "four": ([(1, 1)] * 3, {(0, 0, 13, 26, 39)}),
    "four wide": ([(0, 1), (0, 20), (0, 1)], {(0, 0, 13, 26, 39)}),
    "three": ([(1, 1)] * 2, {(0, 0, 13, 26), (1, 83, 96, 109), (1, 84, 97, 110)}),
    "two": ([(1, 1)], {(0, 0, 13), (1, 83, 96), (1, 84, 97)}),
    "one": ([], {(0, 0), (1, 37), (0, 48), (1, 83), (1, 84)}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_four_mers(spark, name):
    gaps, want = CASES[name]
    reads = spark.createDataFrame([(i, *r.split()) for i, r in enumerate(READS)], "sample int, mer0 string, mer1 string, mer2 string, mer3 string")
    tiles = spark.createDataFrame([("g", i, s) for i, s in enumerate(GENOME)], "chr string, chunk_no long, seq string")
    got = P.place_gapped(reads, K.all_kmers(tiles, 12, 12), 12, gaps).drop("chr").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def _strands(spark, rows):
    """Ids 2i forward and 2i+1 reverse."""
    reads = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "read int, mer0 string, mer1 string")
    return R.both_strands(reads, ["mer0", "mer1"]).selectExpr("read * 2 + side as sample", "mer0", "mer1")


def test_sixteen_mers_with_small_gap(spark):
    # Reads, genome tiles and placements.
    a, b = "acgtacgtacgtacgt", "agctagctagctagct"
    half = ["acgtacgtgggacgta", "cgtttttttttttttt", *["tttttttttttttttt"] * 4, "tttagctagcttttag", "ctagctaaaaaaaaaa"]
    genome = spark.createDataFrame([("g", "".join(half * 2))], "chr string, seq string")
    reads = _strands(spark, [(a, b), ("a" * 16, "c" * 16), (a, b), (b, a)])
    got = P.place_gapped(reads, K.all_gapped_kmers(genome, 16, 3, 4, 8), 16, [(16, 300)]).drop("chr").collect()
    want = {(7, 0, 198), (4, 0, 198), (0, 0, 198), (6, 198, 256), (5, 198, 256), (1, 198, 256), (7, 256, 454), (4, 256, 454), (0, 256, 454)}
    assert {tuple(r) for r in got} == want


def test_fourteen_mers_with_small_gap(spark):
    # Reads, genome tiles and placements.
    t = "t" * 14
    genome = ["acgtacggggtacg", "tacttttttttttt", *[t] * 4, "tttagctagctttt", "agctagacgtacgg", "gggtacgtactttt", *[t] * 7,
              "ttttttttttagct", "agctttttagctag", "ctccccccccccgg", "gggggggggggg"]
    rows = [("acgtacgtacgtac", "agctagctagctag"), ("a" * 14, "c" * 14), ("acgtacgtacgtac", "agctagctagctag"), ("ctagctagctagct", "gtacgtacgtacgt")]
    chunked = spark.createDataFrame([("g", "".join(genome))], "chr string, seq string")
    got = P.place_gapped(_strands(spark, rows), K.all_gapped_kmers(chunked, 14, 3, 4, 7), 14, [(14, 300)]).drop("chr").collect()
    assert {tuple(r) for r in got} == {(7, 0, 174), (4, 0, 174), (0, 0, 174), (7, 209, 469), (4, 209, 469), (0, 209, 469)}


def test_reads_with_too_many_places_are_dropped(spark):
    rows = [(10, p) for p in (1, 2, 3)] + [(20, p) for p in (1, 2, 3, 4)]
    got = O.max_placements(spark.createDataFrame(rows, "sample int, pos0 int"), 3).collect()
    assert {tuple(r) for r in got} == {(3, 10, p) for p in (1, 2, 3)}
