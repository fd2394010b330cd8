from textsentry import job


def test_policies_command(tmp_path, capsys):
    (tmp_path / "p.yml").write_text("name: p\nrules: [{name: a, detector_type: pii, chain: [z]}]")
    assert job.main(["policies", str(tmp_path / "p.yml")]) == 1
    assert "no rule z" in capsys.readouterr().out
    (tmp_path / "q.yml").write_text("name: p")
    assert job.main(["policies", str(tmp_path / "q.yml")]) == 0


def test_scan_and_redact(spark, tmp_path, capsys):
    (tmp_path / "p.yml").write_text("name: p\nrules: [{name: a, detector_type: pii, action: deny}]")
    assert job.main(["scan", "SSN 123-45-6789", "--policy", str(tmp_path / "p.yml"), "--json"]) == 0
    assert '"action":"deny"' in capsys.readouterr().out
    (tmp_path / "x.txt").write_text("SSN 123-45-6789")
    assert job.main(["redact", str(tmp_path / "x.txt"), "--strategy", "mask"]) == 0
    assert "***********" in capsys.readouterr().out
