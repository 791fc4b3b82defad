"""Manifest files read token by token."""

import random

from strandline.operators import storage as S


def plain(paths):
    want = set()
    for path in paths:
        for line in path.read_text().split("\n"):
            stream, *tokens = line.split(" ")
            want |= {(path.name, stream, i, token) for i, token in enumerate(tokens)}
    return want


def test_streams_over_many_splits(spark, tmp_path):
    rng = random.Random(6)
    block = lambda: f"{rng.getrandbits(128):032x}+{rng.randint(1, 99)}"
    line = lambda name, n: " ".join([name, *[block() for _ in range(n)], "0:9:a.txt"])
    texts = {"long": line("./s", 6000), "some": "\n".join(line(f"./s{i}", rng.randint(0, 40)) for i in range(200)) + "\n",
             "odd": "./alone\n./a x  y\n./none\n\n./b z", "one": "./s", "empty": "", "twice": line("./s", 2) + "\n" + line("./t", 1)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = S.read_manifest_tokens(spark, str(tmp_path))
        found = sorted((r.manifest.rsplit("/", 1)[1], r.stream, r.i, r.token) for r in got.collect())
        assert found == sorted(plain(tmp_path.iterdir()))
        blocks = S.parse_manifest_tokens(got)[1].where("manifest like '%/long'").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(blocks) == 6000 and all(b.first == a.first + a.size for a, b in zip(blocks, blocks[1:]))
