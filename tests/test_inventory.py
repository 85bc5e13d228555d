"""The inventory of a real folder of snapshots."""

import hashlib
import json

from pagetide.sources.inventory import artifact_problems, list_artifacts
from pagetide.sources.tables import read_snapshots


def test_problems_of_a_folder(spark, tmp_path):
    def put(slug, page_type, size=5, **files):
        at = tmp_path / "snapshots" / slug / page_type
        at.mkdir(parents=True)
        bodies = {"page.html": "é" * 2 + "x" * (size - 4), "page.txt": "t", "meta.json": json.dumps({"county": slug, "page_type": page_type, "byte_size": 5, "text_sha256": hashlib.sha256(b"" if files.get("page_txt") == "" and slug == "deaf_smith" else b"t").hexdigest()})}
        for name, body in {**bodies, **{k.replace("_", "."): v for k, v in files.items()}}.items():
            if body is not None:
                (at / name).write_text(body)

    put("deaf_smith", "homepage")
    put("deaf_smith", "polling", page_txt=None)
    put("deaf_smith", "results", page_txt="")
    put("polk", "homepage", size=9)
    put("polk", "polling", page_html="")
    put("polk", "results")
    put("polk", "elections", page_txt="")
    put("nowhere", "homepage")
    (tmp_path / "snapshots" / "notes.txt").write_text("no artifact")
    (tmp_path / "snapshots" / "polk" / "page.html").write_text("no artifact either")
    targets = spark.createDataFrame([("Deaf Smith ", t, "https://x/") for t in ("homepage", "polling", "results", "elections")] + [("Polk", t, "" if t == "results" else "https://y/") for t in ("homepage", "polling", "results", "elections")], "county string, page_type string, url string")
    root = f"{tmp_path}/snapshots"
    found = list_artifacts(spark, root)
    assert found.count() == 20 and {r["name"] for r in found.collect()} == {"page.html", "page.txt", "meta.json"}
    meta = read_snapshots(spark, root).withColumnRenamed("page_type", "_t").withColumnRenamed("folder_type", "page_type")
    got = sorted(tuple(r) for r in artifact_problems(targets, found, meta).collect())
    gap = [("polk", "results", n, "gap") for n in ("meta.json", "page.html", "page.txt")]
    unknown = [("nowhere", "homepage", n, "unknown") for n in ("meta.json", "page.html", "page.txt")]
    assert got == sorted([("deaf_smith", "polling", "page.txt", "missing"), ("polk", "homepage", "page.html", "size"), ("polk", "polling", "page.html", "missing"), ("polk", "elections", "page.txt", "missing"), *gap, *unknown])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema") :].split("\n")[0]
