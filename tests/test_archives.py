"""Tar archives against the same folders."""

import io
import json
import tarfile

from pyspark.sql import functions as F

from paperloom.sources import archives, files


def packed(path, members):
    with tarfile.open(path, "w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))


REPORTS = [(f"suite{i % 3}/report{i}.json", "\n".join(json.dumps({"suite": f"s{i % 3}", "metric": f"m{k}", "value": i * k / 2}) for k in range(3)).encode()) for i in range(12)]


def test_a_tar_and_its_folder_give_equal_rows(spark, tmp_path):
    (tmp_path / "tars").mkdir()
    packed(tmp_path / "tars/a.tar", [*REPORTS[:8], ("note.txt", b"no report"), ("x" * 150 + ".json", REPORTS[0][1])])
    packed(tmp_path / "tars/b.tar", [*REPORTS[5:], ("empty.json", b"")])
    (tmp_path / "folder").mkdir()
    for i, (_, content) in enumerate(REPORTS):
        (tmp_path / f"folder/{i}.json").write_bytes(content)
    found, problems = archives.import_archives(spark, str(tmp_path / "tars"))
    want = files.import_reports(spark, str(tmp_path / "folder"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and problems.count() == 0
    members = archives.read_archives(spark, str(tmp_path / "tars"), bytes=300)
    assert members.rdd.getNumPartitions() > 4
    assert {r.member: bytes(r.content) for r in members.where(F.col("archive").endswith("a.tar")).collect()} == dict([*REPORTS[:8], ("note.txt", b"no report"), ("x" * 150 + ".json", REPORTS[0][1])])


def test_damaged_members_are_named(spark, tmp_path):
    packed(tmp_path / "cut.tar", REPORTS[:3])
    whole = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[: 2 * 1024 + 512 + 20])
    packed(tmp_path / "bad.tar", REPORTS[:2])
    spoiled = bytearray((tmp_path / "bad.tar").read_bytes())
    spoiled[1024 : 1024 + 512] = b"\xff" * 512
    (tmp_path / "bad.tar").write_bytes(spoiled)
    (tmp_path / "none.tar").write_bytes(b"")
    reports, problems = archives.import_archives(spark, str(tmp_path))
    named = {(r.archive.rsplit("/", 1)[1], r.member): r.problem for r in problems.collect()}
    assert named[("cut.tar", REPORTS[2][0])] == "content is cut off"
    assert ("bad.tar", "bad.tar") in named and "damaged" in named[("bad.tar", "bad.tar")]
    assert reports.select("sha256").distinct().count() == 2  # the first two of one, the first of the other


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("s", f"m{i:02d}", float(i)) for i in range(30)] + [("t", "a|b", None)], "suite string, metric string, value double")
    archives.write_markdown(df, str(tmp_path / "md"))
    lines = [line for p in sorted((tmp_path / "md/suite=s").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == [f"| m{i:02d} | {float(i)} |" for i in range(30)]
    assert [p.read_text() for p in (tmp_path / "md/suite=t").glob("part-*")] == ["| a\\|b | n/a |\n"]
