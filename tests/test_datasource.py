"""Pages through spark.read.format and write.format."""

import os
import pickle

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from quillmesh.schema import conform
from quillmesh.sources import datasource, markdown


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    datasource.register(spark)
    for i in range(7):
        (root / "people").mkdir(exist_ok=True)
        (root / "people" / f"p{i}.md").write_text(f"---\nid: p{i}\ntitle: P {i}\ntags: [a, b]\nrelationships:\n- target: p0\n  type: knows\n  strength: 0.5\n---\n\nbody {i}\n")
    (root / "plain.md").write_text("# Plain")
    (root / "other.txt").write_text("x")
    (root / ".knowledge").mkdir()
    (root / ".knowledge" / "hidden.md").write_text("---\nid: h\n---\n")
    return root


def read(spark, root, **options):
    return spark.read.format("quillmesh").options(**options).load(str(root))


def test_reads_what_the_scan_reads(spark, kb):
    got = read(spark, kb, filesPerTask=2)
    want, bad = markdown.load(spark, str(kb))
    columns = want.columns
    assert sorted(map(str, got.where("error = ''").select(*columns).collect())) == sorted(map(str, want.collect()))
    assert [r["source_path"] for r in got.where("error <> ''").collect()] == [r["path"] for r in bad.collect()] == [f"{kb}/plain.md"]
    assert got.rdd.getNumPartitions() == 4
    assert read(spark, kb, strict="false").where("error <> ''").count() == 0 and read(spark, kb, pattern="*.txt").count() == 1


def test_filters_choose_files(spark, kb):
    reader = datasource.PagesReader({"path": str(kb)})
    rest = list(reader.pushFilters([StringStartsWith(("source_path",), f"{kb}/people"), StringEndsWith(("source_path",), ".md"), StringContains(("source_path",), "p3"), EqualTo(("title",), "x"), IsNotNull(("source_path",))]))
    assert [type(f).__name__ for f in rest] == ["EqualTo", "IsNotNull"]
    assert [p for part in reader.partitions() for p in part.paths] == [f"{kb}/people/p3.md"]
    reader = datasource.PagesReader({"path": str(kb)})
    assert list(reader.pushFilters([In(("source_path",), (f"{kb}/people/p1.md", "no")), EqualTo(("source_path",), f"{kb}/people/p1.md")])) == []
    assert [p for part in reader.partitions() for p in part.paths] == [f"{kb}/people/p1.md"]
    found = read(spark, kb, filesPerTask=1).where(F.col("source_path").startswith(f"{kb}/people/p1")).where("id = 'p1'")
    assert [r["title"] for r in found.collect()] == ["P 1"] and found.rdd.getNumPartitions() == 1


def files(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_writes_whole_or_not_at_all(spark, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    pages = conform(spark.createDataFrame([("a", "A", "one", "x/a.md"), ("b", "B", "two", f"{root}/b.md")], "id string, title string, body string, source_path string"))
    save = lambda df: df.repartition(3).write.format("quillmesh").mode("append").save(str(root))
    save(pages)
    assert files(root) == ["b.md", "x/a.md"]
    back = read(spark, root)
    assert sorted((r["id"], r["title"], r["body"], r["error"]) for r in back.collect()) == [("a", "A", "one", ""), ("b", "B", "two", "")]
    before = {f: (root / f).read_text() for f in files(root)}
    changed = pages.withColumn("title", F.lit("new"))
    for bad in (
        changed.withColumn("body", F.when(F.col("id") == "b", F.raise_error(F.lit("broken"))).otherwise("z")), changed.withColumn("source_path", F.lit("same.md")),
        changed.withColumn("source_path", F.when(F.col("id") == "a", "../out.md").otherwise("c.md")), changed.withColumn("source_path", F.lit("")),
    ):
        with pytest.raises(Exception):  # noqa: B017
            save(bad)
        assert {f: (root / f).read_text() for f in files(root)} == before and os.listdir(tmp_path) == ["out"] and not [d for d in os.listdir(root) if d.startswith(".")]
    save(changed)
    assert {r["title"] for r in read(spark, root).collect()} == {"new"}
    with pytest.raises(Exception):  # noqa: B017
        pages.write.format("quillmesh").mode("overwrite").save(str(root))
    with pytest.raises(Exception):  # noqa: B017
        pages.drop("tags").write.format("quillmesh").mode("append").save(str(root))


def test_commit_and_listing_hold_no_path_of_each_page(tmp_path, monkeypatch):
    monkeypatch.setattr(datasource, "LIST_BYTES", 100)
    empty = markdown.parse("---\nid: x\n---\n")
    pages = [[Row(**empty | {"title": f"{t}-{n}", "source_path": f"d{n % 3}/p{t}-{n}.md"}) for n in range(2000)] for t in range(2)]
    writer = datasource.PagesWriter({"path": str(tmp_path)})
    staged = [writer.write(iter(rows)) for rows in pages]
    assert all(len(pickle.dumps(m)) < 8000 for m in staged) and not [f for f in files(tmp_path) if not f.startswith(datasource.STAGING)]
    writer.commit([*staged, None])
    assert files(tmp_path) == sorted(r["source_path"] for rows in pages for r in rows)
    reader = datasource.PagesReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [500] * 8 and all(len(pickle.dumps(p)) < 6000 for p in parts)
    assert sorted(r[1] for p in parts for r in reader.read(p)) == sorted(r["title"] for rows in pages for r in rows)
    assert [p.paths for p in datasource.PagesReader({"path": str(tmp_path / "none")}).partitions()] == [[]]

    writer = datasource.PagesWriter({"path": str(tmp_path)})
    again = [Row(**empty | {"title": "new", "source_path": p}) for p in ("d0/p0-0.md", "d1/p1-1.md", "z.md")]
    staged = [writer.write(iter(again)), writer.write(iter(again[1:]))]
    with pytest.raises(ValueError, match=r"d1/p1-1.md, .*/z.md"):
        writer.commit(staged)
    assert files(tmp_path) == sorted(r["source_path"] for rows in pages for r in rows) and markdown.read_file(f"{tmp_path}/d0/p0-0.md")["title"] == "0-0"
