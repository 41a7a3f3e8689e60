"""Settings, name keys and plane fingerprints."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackloom.functions import keys, settings


def test_settings_name_what_is_wrong():
    for bad, word in (({"threshold": 0}, "threshold"), ({"min_area": 5000}, "min_area"), ({"sigma": float("nan")}, "sigma"), ({"regions": ((0.5, 0, 0.4, 1),)}, "region")):
        with pytest.raises(ValueError, match=word):
            settings.DetectSettings(**bad)
    with pytest.raises(ValueError, match="pad_s"):
        settings.StabilitySettings(pad_s=-1)
    assert settings.RenderSettings().max_tracks == 300


def test_half_windows():
    assert settings.half_window(settings.DetectSettings(), 30, 960 * 720) == 15
    for bad in ({"window_s": 0.01}, {"step": 20}):
        with pytest.raises(ValueError):
            settings.half_window(settings.DetectSettings(**bad), 30, 960 * 720)
    with pytest.raises(ValueError, match="bytes"):
        settings.half_window(settings.DetectSettings(window_s=60), 30, 1440 * 1080)


def test_names_in_normal_form(spark):
    rows = spark.createDataFrame([("É.mp4",), ("É.MP4",), (None,)], "n string").select(keys.name_key("n").alias("k")).collect()
    assert [r["k"] for r in rows] == ["é.mp4", "é.mp4", None]


def test_plane_keys_tell_planes_apart(spark):
    rows = [(2, 4, bytes(range(8))), (4, 2, bytes(range(8))), (2, 4, bytes(range(1, 9))), (3, 3, bytes(9)), (3, 3, None)]
    out = [r["k"] for r in spark.createDataFrame(rows, "w int, h int, p binary").select(keys.plane_keys("w", "h", "p").alias("k")).collect()]
    assert len(set(out)) == 5 and out[4] is None and out[0] == f"{keys.plane_key(2, 4, bytes(range(8))):016x}"
    state = keys.OFFSET
    for data in ((2).to_bytes(4, "little"), (4).to_bytes(4, "little")):
        for byte in data:
            state = keys._step(state, byte)
        state = keys._step(state, 4)
    assert keys._step(keys._step(state, int.from_bytes(bytes(range(8)), "little")), 8) == keys.plane_key(2, 4, bytes(range(8)))
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_entry_is_read_without_a_session_and_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "trackloom", tmp_path / "trackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[0]) > 100
