"""Every card runs on a small surface, and known ones give what they should."""

import json

import pytest

from geolode.plans import cards
from geolode.sources import tables


def surface(spark, z, n=6):
    v = spark.createDataFrame([(j * n + i, float(i), float(j), float(z(i, j))) for j in range(n) for i in range(n)], "vid long, x double, y double, z double")
    return cards.Surface(v, tables.lattice_faces(v, n))


def test_known_cards(spark):
    s, level = surface(spark, lambda i, j: i - 2.5), surface(spark, lambda i, j: 0)
    run = lambda family, kind, *a, **k: cards.CARDS[family][kind](s, *a, **k)
    assert run("analysis", "slope").first().mean_slope == pytest.approx(100)
    assert {r.sector for r in run("analysis", "aspect").collect()} == {"W"}
    v = run("analysis", "cut-fill", level).first(), run("analysis", "earthwork", level).first()
    assert v[0].cut == pytest.approx(v[1].cut) == pytest.approx(v[0].fill) == pytest.approx(v[1].fill) and v[0].cut > 0
    assert run("analysis", "catchment").first().outlet == "border"
    assert {r.level for r in run("annotation", "contour", interval=1.0).collect()} == {-2.0, -1.0, 0.0, 1.0, 2.0}
    p = spark.createDataFrame([(1, 2.25, 3.5), (2, 90.0, 0.0)], "pid long, x double, y double")
    assert {r.pid: r.z for r in run("marker", "slope", p).collect()} == {1: pytest.approx(-0.25), 2: None}
    assert run("modifier", "project-to", level).where("abs(z) > 1e-12").count() == 0
    f = run("object", "surface-oriented", p).first()
    assert (f.ux, f.uz, f.vy) == pytest.approx((0.5**0.5, 0.5**0.5, 1)) and f.nx == pytest.approx(-(0.5**0.5))
    assert run("modifier", "triangulate").count() == 50
    assert run("modifier", "clean").count() == 50


def test_stacks_are_kept_with_their_settings():
    text = cards.settings_json([("analysis", "slope", {}), ("modifier", "smooth", {"rounds": 9})])
    assert cards.from_json(text) == [("analysis", "slope", {"unit": "percent"}), ("modifier", "smooth", {"rounds": 9, "strength": 0.5})]
    with pytest.raises(KeyError):
        cards.from_json(json.dumps([{"family": "analysis", "kind": "nothing", "settings": {}}]))
