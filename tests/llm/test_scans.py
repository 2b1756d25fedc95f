import numpy as np

from textloom.llm.boosting import Boosted
from textloom.llm.scans import repaired, scan_findings, skeleton

WORDS = "the river stands before every silver garden while their mother gathers harvest under morning light because nothing returns without labour and patience within houses of stone".split()


def clean_text(spark):
    rows = [(" ".join(WORDS[k % 25 :] + WORDS[: k % 25]) + ".",) for k in range(40)] + [("a corn-measure and a corn-measure stands",)] * 3
    return spark.createDataFrame(rows, "body string")


def scans(spark):
    rows = [
        ("old-garden", 0, 0, "CHAPTER II.\nOf rivers and stones", None, True),
        ("old-garden", 1, 0, "The river stands before tlie har-\nvest. Every corn-\nmeasure returns without", "1", False),
        ("old-garden", 2, 0, "- 75 -\nOLD GARDEN", None, True),
        ("old-garden", 3, 0, "labour and patience.", "1", False),
        ("old-garden", 3, 0, "labour and patience.", "1", False),
        ("old-garden", 4, 0, "", "2", False), ("old-garden", 5, 0, None, "2", False),
    ]
    return spark.createDataFrame(rows, "work_id string, n int, part int, raw string, ref string, apparatus boolean")


def test_findings_and_repair(spark):
    got = scan_findings(scans(spark), clean_text(spark))
    found = {(r["n"], r["line_no"], r["kind"]) for r in got["found"].collect()}
    assert found == {(1, 0, "hyphen"), (1, 0, "misread"), (1, 2, "continued"), (2, 0, "page_no"), (2, 1, "header")}
    text = {r["n"]: r["text"] for r in repaired(got).collect()}
    assert text == {1: "The river stands before the harvest. Every corn-measure returns without labour and patience."}


def test_empty(spark):
    assert scan_findings(scans(spark).limit(0), clean_text(spark))["found"].count() == 0
    assert {r["kind"] for r in scan_findings(scans(spark), clean_text(spark).limit(0))["found"].collect()} >= {"header", "page_no", "continued"}


def test_skeleton():
    assert skeleton("tlie") == skeleton("the") and skeleton("m0rning") == skeleton("morning") and skeleton("be,side") == skeleton("beside")


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = Boosted(60).fit(x[:600], y[:600])
    assert ((m.score(x[600:]) > 0.5) == y[600:]).mean() > 0.9
