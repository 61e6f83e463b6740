import json
from pathlib import Path

from tidemill.cli import main


def rows(path):
    return [json.loads(line) for p in Path(path).glob("part-*.json") for line in p.read_text().splitlines()]


def test_scenes_audit_evaluate(spark, tmp_path, capsys):
    train, held, out = (str(tmp_path / n) for n in ("train", "held", "out"))
    assert main(["scenes", train, "--family", "survival,energy", "--scenes", "3", "--seed", "5"]) == 0
    assert main(["scenes", held, "--family", "survival", "--scenes", "3", "--seed", "500"]) == 0
    assert main(["audit", out, "--base", train, "--held-out", held]) == 0
    assert main(["audit", out, "--base", train, "--held-out", train]) == 1
    assert main(["evaluate", out, "--base", train, "--limit", "10"]) == 0
    assert rows(f"{out}/rollup")[0]["records"] == 10
    assert main(["rescue", out, "--seeds", "900-901"]) == 0
    assert {r["condition"] for r in rows(f"{out}/conditions")} == {"normal", "blocked", "unsafe"}
    assert main(["doctor"]) == 0


def test_smoke_repeats_the_published_world(spark, tmp_path):
    out = str(tmp_path / "smoke")
    assert main(["smoke", out, "--founders", "4", "--steps", "30"]) == 0
    (summary,) = rows(f"{out}/summary")
    assert (summary["ticks"], summary["born"], summary["died"], summary["living"], summary["mean_living_energy"]) == (30, 1, 1, 4, 10.5)
    assert spark.read.parquet(f"{out}/events").where("kind = 'decision'").count() == 129
