"""The mail archive source: offsets, filters, caps, compressed archives."""

import io
import tarfile

import pytest
from corvane.sources import archives as A
from pyspark.sql import functions as F


def pack(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, text in members:
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        tar.addfile(tarfile.TarInfo("maildir/ann/sent/a_link"))
        link = tarfile.TarInfo("maildir/ann/sent/link")
        link.type = tarfile.SYMTYPE
        link.linkname = "1"
        tar.addfile(link)


MEMBERS = [(f"maildir/{a}/{f}/{k}", f"{a} {f} {k} é" * (k + 1)) for k in range(9) for a in ("ann", "bob", "eve") for f in ("Sent", "inbox")] + [("other/ann/sent/1", "no"), ("maildir/short", "no")]


@pytest.mark.parametrize("mode, name", [("w", "x.tar"), ("w:gz", "x.tar.gz")])
def test_members(spark, tmp_path, mode, name):
    pack(str(tmp_path / name), MEMBERS, mode)
    every = A.mail_archive(spark, str(tmp_path), splitBytes=300).filter("member NOT LIKE '%link'")
    assert sorted((r.member, r.text) for r in every.collect()) == sorted(MEMBERS[:54])
    some = A.mail_archive(spark, str(tmp_path), folders="sent", perAuthor=4).filter(F.col("author").isin("ann", "eve") & (F.length("text") > 0))
    assert sorted((r.author, r.folder, r.place, r.text) for r in some.collect()) == sorted((a, "sent", k, f"{a} Sent {k} é" * (k + 1)) for a in ("ann", "eve") for k in range(4))
    assert A.mail_archive(spark, str(tmp_path)).filter("folder = 'inbox' AND author = 'bob'").count() == 9
    assert A.mail_archive(spark, str(tmp_path)).filter("author = 'nobody'").count() == 0


def test_the_walk_ends_when_all_authors_are_full(tmp_path):
    path = str(tmp_path / "y.tar")
    pack(path, MEMBERS)
    seen = []

    class Watched(tarfile.TarFile):
        def next(self):
            found = super().next()
            seen.append(found)
            return found

    with Watched.open(path) as archive:
        found = list(A.Wanted("maildir", frozenset(["ann", "bob"]), frozenset(["sent"]), 2).walk(archive))
    assert [(a, k) for _, a, _, k in found] == [("ann", 0), ("bob", 0), ("ann", 1), ("bob", 1)] and len(seen) < 12


def test_parts_hold_ranges_and_not_members(tmp_path):
    path = str(tmp_path / "z.tar")
    pack(path, [(f"maildir/a/sent/{k}", "x" * 1000) for k in range(50)])
    reader = A.ArchiveReader({"path": path, "splitBytes": "5000"})
    parts = reader.partitions()
    assert len(parts) == 10 and all(sum(m[5] for m in p.members) <= 5000 for p in parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 51


def test_archives_that_spark_wrote(spark, tmp_path):
    rows = [("s1", "maildir/s1/en/2", "two"), ("s1", "maildir/s1/en/1", None), ("s2", "maildir/s2/fr/1", "un")]
    files = spark.createDataFrame(rows, "archive string, member string, text string")
    assert sorted(r[0] for r in A.write_archives(files, str(tmp_path / "out"), "archive", "member", "text").collect()) == ["s1", "s2"]
    got = A.mail_archive(spark, str(tmp_path / "out")).collect()
    assert sorted((r.path[-6:], r.member, r.place, r.text) for r in got) == [("s1.tar", "maildir/s1/en/1", 0, ""), ("s1.tar", "maildir/s1/en/2", 1, "two"), ("s2.tar", "maildir/s2/fr/1", 0, "un")]
