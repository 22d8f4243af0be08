"""Records of multi-line CSV, cut at every byte, against the reader that does not split."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litspark.sources import csv_records
from litspark.sources.csv_records import inside_after, read_csv_records


def plain(spark, path):
    raw = spark.read.option("header", True).option("multiLine", True).options(**csv_records.OPTIONS).csv(path)
    return [tuple(r) for r in raw.withColumn("f", F.col("_metadata.file_name")).collect()]


def split_read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        rows = read_csv_records(spark, path).orderBy("file", "block", "line").collect()
        return [(*r.cells, r.file.rsplit("/", 1)[-1]) for r in rows], len({(r.file, r.block) for r in rows})
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")


TEXT = 'a,b,c\n1,"two\nlines, ""quoted""",x\n\n2,"",\n3,"""",y\n"4\n\n\n",its,"z"\n5,"a ""b""\n""c"", d",\n6,é中,"\n"\n7,last,"no newline at the end"'


def cut_by_hand(raw, size):
    """Records as the passes over blocks make them, without Spark: lines belong to the block in which they start."""
    lines, at = [], 0
    for line in raw.split(b"\n"):
        if at < len(raw):  # what follows the last line break is no line
            lines.append((at // size * size, line))
        at += len(line) + 1

    def batches(rows):
        for k in range(0, len(rows), 3):
            part = rows[k : k + 3]
            yield pa.RecordBatch.from_pydict({"file": ["f"] * len(part), "block": [r[0] for r in part], "line": [r[1] for r in part]})

    blocks = [(b, [r for r in lines if r[0] == b]) for b in sorted({r[0] for r in lines})]
    effects = [e for _, rows in blocks for out in csv_records._effects(batches(rows)) for e in out.to_pylist()]
    state, inside = False, set()
    for e in effects:
        if state:
            inside.add(("f", e["block"]))
        state = e["inside"] if state else e["outside"]
    work = csv_records._assembled(frozenset(inside), frozenset(["f"] if effects and effects[0]["crlf"] else []))
    found, chain = [], None
    for _, rows in blocks:
        for out in work(batches(rows)):
            for r in out.to_pylist():
                if r["piece"] is None:
                    found.append((r["block"], r["line"], r["text"]))
                elif r["piece"] == "open":
                    found.append((r["block"], r["line"], r["text"]))
                else:
                    b, n, t = found.pop()
                    found.append((b, n, t + "\n" + r["text"]))
    assert found == sorted(found, key=lambda r: r[:2]) and len({r[:2] for r in found}) == len(found)
    return [t for _, _, t in found]


def by_python(text):
    """Records cut at line ends outside of quotes, blank lines left out."""
    out, record, inside = [], [], False
    for line in text.split("\n"):
        record.append(line)
        inside ^= line.count('"') % 2 == 1
        if not inside:
            out.append("\n".join(record))
            record = []
    return [r for r in [*out, *(["\n".join(record)] if record else [])] if r]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_every_cut(ending):
    raw = TEXT.replace("\n", ending).encode()
    for size in range(1, len(raw) + 2):
        assert cut_by_hand(raw, size) == by_python(TEXT), size
    rnd = random.Random(9)
    for _ in range(150):
        text = random_text(rnd, 8)
        raw = text.replace("\n", ending).encode()
        for size in (1, 4, 7, 19, 50, 10**6):
            assert cut_by_hand(raw, size) == by_python(text)


def random_text(rnd, n):
    def cell():
        if rnd.random() < 0.3:
            return "".join(rnd.choice("xyé 1'") for _ in range(rnd.randrange(6)))
        inner = "".join(rnd.choice(['""', ",", "\n", "\n\n", "word", " ", "é"]) for _ in range(rnd.randrange(9)))
        return f'"{inner}"'

    lines = ["title,text,n"] + [",".join(["t" + str(i), cell(), cell()]) for i in range(n)]
    return "\n".join(lines) + "\n" * rnd.randrange(3)


def test_equals_the_reader_that_does_not_split(spark, tmp_path):
    """Files with either line end and a byte order mark, in many blocks, in one folder."""
    rnd, folder = random.Random(1), tmp_path / "d"
    folder.mkdir()
    for k in range(3):
        text = ("\ufeff" if k == 2 else "") + random_text(rnd, 40)
        (folder / f"part{k}.csv").write_bytes(text.replace("\n", "\r\n" if k == 1 else "\n").encode())
    want = sorted(plain(spark, str(folder)), key=lambda r: (r[-1], int(r[0][1:])))
    got, blocks = split_read(spark, str(folder), 150)
    assert got == want and blocks > 12
    got, blocks = split_read(spark, str(folder), 10**6)
    assert got == want and blocks == 3


def test_bare_quotes_and_open_ends(spark, tmp_path):
    """Quotes within unquoted cells mean nothing; a cell that nothing closes takes the rest of the file."""
    for name, text in {"bare.csv": 'a,b\n1,x"y\n2"","z""\n"\n3 "q",w\n', "open.csv": 'a,b\n1,"x\n2,y\n3,z\n'}.items():
        (tmp_path / name).write_text(text)
        want = plain(spark, str(tmp_path / name))
        for size in (6, 100):
            got, _ = split_read(spark, str(tmp_path / name), size)
            assert [tuple(x.rstrip("\n") if x else x for x in r) for r in got] == [tuple(x.rstrip("\n") if x else x for x in r) for r in want]


def test_state_of_lines():
    rnd = random.Random(2)
    for _ in range(3000):
        cells = []
        for _ in range(rnd.randrange(1, 5)):
            inner = "".join(rnd.choice(['""', ",", "x", " "]) for _ in range(rnd.randrange(5)))
            cells.append(f'"{inner}"' if rnd.random() < 0.6 else inner.replace('""', "").replace(",", ""))
        line = ",".join(cells)
        assert not inside_after(line.encode(), False)
        start = line.find('"')
        if start >= 0 and (start == 0 or line[start - 1] == ","):
            opened = line[:start] + '"open ""' + '""' * rnd.randrange(2)
            assert inside_after(opened.encode(), False)
            assert not inside_after(b'still ""open"", it"' + (b"," + line.encode() if line else b""), True)
            assert inside_after(b'still ""open"", it', True)


def test_unlike_headers_fail(spark, tmp_path):
    for k, head in enumerate(["a,b", "b,a"]):
        (tmp_path / f"p{k}.csv").write_text(f"{head}\n1,2\n")
    with pytest.raises(Exception, match="not the header"):
        read_csv_records(spark, str(tmp_path)).collect()
    (tmp_path / "p1.csv").write_text('"a","b"\n3,4\n')
    assert sorted(r.cells.a for r in read_csv_records(spark, str(tmp_path)).collect()) == ["1", "3"]
