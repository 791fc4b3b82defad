"""Readers that cut files at record borders, against plain Python on files with every kind of border."""

import bz2
import gzip
import random
import re

import pytest

from strandline.sources import formats as M, records as R


def rows(df):
    return sorted(map(tuple, df.collect()))


def put(folder, name, text, opener=open):
    folder.mkdir(parents=True, exist_ok=True)
    with opener(folder / name, "wb") as f:
        f.write(text.encode())


def plain_fasta(text, chunk):
    found = []
    for line in text.split("\n"):
        if line.startswith(">"):
            found.append([(line[1:].split() or [""])[0], ""])
        elif found:
            found[-1][1] += re.sub(r"\s", "", line)
    return [(n + 1, name, i + m.start(), m.group()) for n, (name, s) in enumerate(found) for i in range(0, len(s), chunk)
            for m in re.finditer("[^NMRnmr]+", s[i:i + chunk])]


def records(rnd, n):
    word = lambda letters, top: "".join(rnd.choice(letters) for _ in range(rnd.randrange(top)))
    return [(f"r{i} {word('xy', 4)}", word("acgt", 40), word("@+I#", 40)) for i in range(n)]


def lines(found, end="\n"):
    return "".join(f"@{a}{end}{b}{end}+{a if len(b) % 2 else ''}{end}{c}{end}" for a, b, c in found)


@pytest.mark.parametrize("size", [13, 300, R.RANGE_BYTES])
def test_fastq_at_every_border(spark, tmp_path, size):
    rnd = random.Random(size)
    found = [records(rnd, n) for n in (12, 9, 0, 7, 5)]
    put(tmp_path / "a", "one.fastq", lines(found[0]))
    put(tmp_path / "b", "one.fastq", lines(found[1], "\r\n"))
    put(tmp_path, "none.fastq", "")
    put(tmp_path, "packed.fastq.gz", lines(found[3]), gzip.open)
    put(tmp_path, "packed.fastq.bz2", lines(found[4]), bz2.open)
    put(tmp_path, "other.txt", "@x\na\n+\nb\n")
    got = R.read_fastq(spark, str(tmp_path), "*.fastq*", size=size)
    assert rows(got.select("name", "bases", "quals")) == sorted(sum(found, []))
    # Records of a file are in the order of their offsets, whatever the ranges.
    one = [r.name for r in got.where("file like '%/a/one.fastq'").orderBy("record").collect()]
    assert one == [r[0] for r in found[0]]
    # Letters are not shuffled: the only exchange lies below the reader and moves ranges.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]


def test_fastq_columns_and_damaged_ends(spark, tmp_path):
    put(tmp_path, "x.fastq", "@a\nac\n+\nII\n@b\ngt\n+")
    assert rows(R.read_fastq(spark, str(tmp_path), columns=("quals", "name"))) == [("", "b"), ("II", "a")]
    put(tmp_path / "cut", "x.fastq", "@a\nac\n+\nII\n@b\ngt")
    for size in (3, 1000):
        assert rows(R.read_fastq(spark, str(tmp_path / "cut"), columns=("name",), size=size)) == [("a",)]
    put(tmp_path / "empty", "x.fastq", "")
    assert rows(R.read_fastq(spark, str(tmp_path / "empty"))) == []


@pytest.mark.parametrize("size, chunk", [(9, 5), (64, 200), (R.RANGE_BYTES, 16)])
def test_fasta_at_every_border(spark, tmp_path, size, chunk):
    rnd = random.Random(size)

    def text(n):
        out = ["stray letters"] if n % 2 else []
        for i in range(n):
            out.append(f">{rnd.choice(['', ' '])}s{i} title > with more")
            seq = "".join(rnd.choice("acgtacgtN") for _ in range(rnd.choice([0, 3, 90])))
            width = rnd.choice([10, 1000])
            out += [seq[j:j + width] for j in range(0, len(seq), width)]
        return "\n".join(out) + rnd.choice(["", "\n", "\n\n"])

    texts = {"a.fa": text(5), "b.fa": text(2), "c.fa.gz": text(4), "e.fa": ""}
    for name, t in texts.items():
        put(tmp_path, name, t, gzip.open if name.endswith("gz") else open)
    got = R.read_fasta(spark, str(tmp_path), chunk, size=size)
    want = sorted((name, *r) for name, t in texts.items() for r in plain_fasta(t, chunk))
    assert sorted((r.file.split("/")[-1], r.record, r.name, r.pos, r.seq) for r in got.collect()) == want


def test_fasta_sequence_in_one_line(spark, tmp_path):
    letters = "".join(random.Random(2).choice("acgt") for _ in range(5000))
    put(tmp_path, "x.fa", f">c\n{letters}")
    got = R.read_fasta(spark, str(tmp_path), 300, size=512)
    assert rows(got.select("record", "name", "pos", "seq")) == [(1, "c", i, letters[i:i + 300]) for i in range(0, 5000, 300)]
    # It is read in several tasks.
    assert got.selectExpr("spark_partition_id()").distinct().count() > 5


def test_table_columns_come_from_the_heads_of_files(spark, tmp_path):
    head = '#: t-0.1/text\n# field "a" "int64"\n# field "b" "sym"\n#.\n'
    put(tmp_path, "1.txt", head + '1 "x y"\n. "z"\n')
    put(tmp_path, "2.txt.gz", head + '5 "w"\n', gzip.open)
    put(tmp_path, "3.txt", "")
    got = M.read_table(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x y"), (None, "z"), (5, "w")], key=str)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "string"]
