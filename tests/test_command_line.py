import json

import pytest

from weftsample.__main__ import main

from .conftest import rows_of


def call(capsys, *words):
    main([str(w) for w in words])
    return json.loads(capsys.readouterr().out.splitlines()[-1])


@pytest.mark.parametrize("kind", ["sliced", "mixed"])
def test_phases_equal_centralized(spark, tmp_path, capsys, kind):
    made = call(
        capsys, "generate", "--kind", kind, "--out", tmp_path / "tables", "--sites", 2,
        "--num-keys", 30, "--overlap", 0.5, "--value-size", 4, "--min-rpk", 2, "--max-rpk", 12,
        "--zipf-param", 2.5,
    )
    prefix, root = made["prefix"], tmp_path / "phases"
    for p in (0, 1):
        call(capsys, "count", "--prefix", prefix, "--root", root, "--site", p, "--sites", 2)
    call(capsys, "merge", "--root", root, "--sites", 2)
    draw = ("--fraction", 0.5, "--seed", 4)
    for p in (0, 1):
        call(capsys, "sample", "--prefix", prefix, "--root", root, "--site", p, "--sites", 2, *draw)
    out = ("--format", "parquet", *draw)
    joined = call(capsys, "join", "--root", root, "--sites", 2, "--out", tmp_path / "a", *out)
    whole = call(
        capsys, "centralized", "--prefix", prefix, "--sites", 2, "--out", tmp_path / "b", *out
    )
    a, b = (rows_of(spark.read.parquet(str(tmp_path / name))) for name in "ab")
    assert a == b and len(a) == joined[0]["n_rows"] == whole[0]["n_rows"] > 0


def test_arguments_are_checked(spark, tmp_path):
    with pytest.raises(SystemExit):
        main(["merge"])
    with pytest.raises(SystemExit, match="zipf-param"):
        main(["generate", "--kind", "zipf", "--out", str(tmp_path), "--sites", "1",
              "--num-keys", "3", "--overlap", "1", "--value-size", "4"])
