"""A vault that changes between runs, a batch that is tried again, and files that cannot be read."""

import os
import shutil

from marginalia.streaming import folder


def write(path, content, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (at, at))


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_runs_over_what_arrives(spark, tmp_path):
    vault, work = tmp_path / "vault", str(tmp_path / "work")
    write(vault / "A" / "one.md", b"# One\r\n[[two]] [[nowhere]]", 1_700_000_000)
    write(vault / "A" / "sub" / "two.md", "# Zwei \u00e9".encode(), 1_700_000_000)
    write(vault / "B" / "bad.md", b"\xff\xfe\x00", 1_700_000_000)
    write(vault / "B" / "no.txt", b"no note", 1_700_000_000)
    folder.ingest_folder(spark, str(vault), work, "all")
    read = lambda name, batch: spark.read.parquet(f"{work}/{name}/version={batch}")
    assert table(read("states", 0), "relative_path", "status", "error_type") == sorted([("A/one.md", "new", None), ("A/sub/two.md", "new", None), ("B/bad.md", "failed", "read_error")], key=repr)
    assert table(folder.current(spark, work), "relative_path", "parse_status", "title") == [("A/one.md", "parsed", "one"), ("A/sub/two.md", "parsed", "two"), ("B/bad.md", "failed", "bad")]
    ids = dict(table(folder.current(spark, work), "relative_path", "note_id"))
    assert table(read("links", 0), "target", "target_note_id") == [("nowhere", None), ("two", ids["A/sub/two.md"])]
    run = read("run", 0).first()
    assert (run["total"], run["new"], run["failed"], run["stale"], run["status"]) == (3, 2, 1, 0, "partial")
    folder.ingest_folder(spark, str(vault), work, "all")  # nothing has arrived
    assert not os.path.exists(f"{work}/run/version=2")

    write(vault / "A" / "one.md", b"# One, changed", 1_700_000_100)
    write(vault / "B" / "bad.md", b"now text", 1_700_000_100)
    write(vault / "B" / "three.md", b"three", 1_700_000_100)
    folder.ingest_folder(spark, str(vault), work, "all")
    assert table(read("states", 2), "relative_path", "status") == [("B/three.md", "new")]
    after = table(folder.current(spark, work), "relative_path", "note_id", "content_hash", "last_status")
    assert [r[0] for r in after] == ["A/one.md", "A/sub/two.md", "B/bad.md", "B/three.md"] and {r[0]: r[1] for r in after} | ids == {r[0]: r[1] for r in after}

    for name in os.listdir(f"{work}/checkpoint/commits"):  # as if the driver had died before the batch was committed
        if name.strip(".crc").lstrip(".") == "1":
            os.remove(f"{work}/checkpoint/commits/{name}")
    shutil.rmtree(f"{work}/links/version=2")
    folder.ingest_folder(spark, str(vault), work, "all")
    assert table(folder.current(spark, work), "relative_path", "note_id", "content_hash", "last_status") == after and os.path.exists(f"{work}/links/version=2")

    (vault / "A" / "sub" / "two.md").unlink()
    for _ in range(2):
        assert folder.rescan(spark, str(vault), work, "all") == 3
        assert table(read("states", 3), "relative_path", "status") == [("A/one.md", "changed"), ("A/sub/two.md", "stale"), ("B/bad.md", "changed"), ("B/three.md", "unchanged")]
    assert {r[0]: r[1] for r in table(folder.current(spark, work), "relative_path", "last_status")} == {"A/one.md": "changed", "A/sub/two.md": "stale", "B/bad.md": "changed", "B/three.md": "unchanged"}
