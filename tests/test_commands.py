import json

import pytest

from colloquy.__main__ import main

VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\n<v Ann Lee>We should look at</v>\n\n00:00:02.600 --> 00:00:04.000\n<v Bo>the contract first.</v>\n\n00:00:05.000 --> 00:00:06.000\n<v ANN LEE>Fine.</v>\n"


@pytest.fixture
def files(tmp_path, spark):
    (tmp_path / "a.vtt").write_text(VTT)
    (tmp_path / "b.md").write_text("nothing here")
    return tmp_path


def test_commands(files, capsys):
    good = str(files / "*.vtt")
    assert main(["formats"]) == 0 and "json:rev" in capsys.readouterr().out
    assert main(["chunk", good, "--json"]) == 0
    row = json.loads(capsys.readouterr().out.splitlines()[0])
    assert row["source"] == "a.vtt" and row["speakers"] == ["Ann Lee", "Bo"] and row["start_ms"] == 1000
    assert main(["chunk", good, "--context"]) == 0 and "(00:01) Ann Lee: We should look at" in capsys.readouterr().out
    assert main(["lint", good, "--fail-on", "medium"]) == 1
    assert main(["report", good, "--fail-on-issues"]) == 1
    for c in ("speakers", "compare"):
        assert main([c, good]) == 0
    capsys.readouterr()
    assert main(["detect", good, str(files / "b.md")]) == 2 and "no known format" in capsys.readouterr().err
    assert main(["detect", str(files / "missing.vtt")]) == 1 and main(["detect"]) == 1
