"""Contents elsewhere, in two stages: only files whose size occurs on both sides are opened."""

import os

from pyspark.sql import functions as F

from siftwork.operators import reconcile
from siftwork.sources import files


def test_only_files_of_equal_size_are_read(spark, tmp_path):
    data = {
        "trash/a": b"same", "trash/b": b"elf!", "trash/c": b"onlyhere!", "trash/d": b"quar1", "trash/e": b"", "trash/f": b"gone",
        "lib/1": b"same", "lib/2": b"same", "lib/3": b"x" * 5_000_000, "lib/4": b"", "lib/5": b"dif1", "qua/1": b"quar1", "qua/2": b"same", "qua/3": b"y" * 3_000_000,
    }
    for path, content in data.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    listing = spark.createDataFrame([(str(tmp_path / p), len(c)) for p, c in data.items()] + [(str(tmp_path / "trash/null"), None)], "path string, size long")
    os.remove(tmp_path / "trash/f")  # vanished since the listing
    under = lambda name: listing.filter(F.col("path").contains(f"/{name}/"))
    reads = []

    def read(paths):
        got = files.hash_files(paths, buffer=3)
        reads.append(got)
        return got

    got = {os.path.relpath(r["path"], tmp_path): (r["in_library"], r["in_quarantine"], os.path.relpath(r["other"], tmp_path) if r["other"] else "") for r in reconcile.content_elsewhere(under("trash"), under("lib"), under("qua"), read).collect()}
    assert got == {
        "trash/a": (True, False, "lib/1"), "trash/b": (False, False, ""), "trash/c": (False, False, ""), "trash/d": (False, True, "qua/1"),
        "trash/e": (True, False, "lib/4"), "trash/f": (False, False, ""), "trash/null": (False, False, ""),
    }
    opened = {os.path.relpath(r["path"], tmp_path): r["bytes"] for r in reads[0].collect()}
    sizes = {p: len(c) for p, c in data.items()}
    both = {s for p, s in sizes.items() if p.startswith("trash")} & {s for p, s in sizes.items() if not p.startswith("trash")}
    assert opened == {p: 0 if p == "trash/f" else s for p, s in sizes.items() if s in both}  # nothing of another size, each once
