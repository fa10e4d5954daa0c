"""The vault source: what is read, what is refused, what is never opened."""

import os

import pytest
from pyspark.errors import PySparkException

from tessella.sources import exchange, vault


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "vault"
    for d in ("a/deep", "b", ".git", "Drafts", "a/.obsidian"):
        (root / d).mkdir(parents=True)
    outside = tmp_path / "vault-other"
    outside.mkdir()
    (outside / "secret.md").write_text("secret")
    (root / "top.md").write_text("---\ntitle: Top\ntags: [x, y]\n---\nsee [[b]]")
    (root / "a" / "one.md").write_text("one")
    (root / "a" / "deep" / "two.md").write_text("zwei: ä")
    (root / "a" / "blank.md").write_text(" \n")
    (root / "a" / "head.md").write_text("---\ntitle: only\n---\n")
    (root / "a" / "other.txt").write_text("no note")
    (root / "a" / "bytes.md").write_bytes(b"\xff\xfe\xff")
    (root / "b" / "large.md").write_text("x" * 5000)
    for d in (".git", "Drafts", "a/.obsidian"):
        (root / d / "hidden.md").write_text("hidden")
    os.symlink(outside / "secret.md", root / "b" / "link.md")
    os.symlink(outside, root / "b" / "linked")
    os.symlink(root / ".git" / "hidden.md", root / "b" / "inner.md")
    os.symlink(root / "a" / "one.md", root / "b" / "same.md")
    os.symlink(root / "nowhere.md", root / "b" / "broken.md")
    return root


def test_outcomes(spark, notes):
    vault.register(spark)
    df = spark.read.format("vault").option("mostBytes", 4000).option("exclude", "Drafts").load(str(notes))
    assert {r.source_url: (r.outcome, r.body) for r in df.select("source_url", "outcome", "body").collect()} == {
        "top.md": ("note", "---\ntitle: Top\ntags: [x, y]\n---\nsee [[b]]"), "a/one.md": ("note", "one"), "a/deep/two.md": ("note", "zwei: ä"), "a/blank.md": ("empty", None),
        "a/head.md": ("note", "---\ntitle: only\n---\n"), "a/bytes.md": ("not_text", None), "b/large.md": ("too_large", None), "b/link.md": ("outside", None),
        "b/inner.md": ("outside", None), "b/same.md": ("note", "one"), "b/broken.md": ("unreadable", None),
    }
    assert df.rdd.getNumPartitions() == 4  # the root, a, a/deep, b


def test_hidden_files_are_never_opened(notes, monkeypatch):
    opened = []
    real_open, real_list = open, os.listdir
    monkeypatch.setattr("builtins.open", lambda p, *a: opened.append(os.path.realpath(p)) or real_open(p, *a))
    monkeypatch.setattr(os, "listdir", lambda p: opened.append(os.path.realpath(p)) or real_list(p))
    reader = vault.VaultReader({"path": str(notes), "exclude": "Drafts"})
    for part in reader.partitions():
        list(reader.read(part))
    told = {os.path.relpath(p, notes) for p in opened}
    assert told == {".", "a", "a/deep", "b", "top.md", "a/one.md", "a/deep/two.md", "a/blank.md", "a/head.md", "a/bytes.md", "b/large.md"}


def test_roots(spark, notes, tmp_path):
    for path in (notes, tmp_path / "nowhere"):  # the same refusal, whether it exists or not
        with pytest.raises((ValueError, PySparkException), match="none of the roots"):
            exchange.read_vault(spark, str(path), roots=(str(tmp_path / "vau"), str(tmp_path / "vault-other"))).collect()
    assert exchange.read_vault(spark, str(notes), ("Drafts",), (str(tmp_path),)).count() == 6
    with pytest.raises((ValueError, PySparkException), match="no folder"):
        exchange.read_vault(spark, str(tmp_path / "nowhere")).collect()


def test_records(spark, notes):
    found = {r.source_url: r for r in exchange.vault_records(exchange.read_vault(spark, str(notes), ("Drafts",))).collect()}
    assert set(found) == {"top.md", "a/one.md", "a/deep/two.md", "b/large.md", "b/same.md"}
    top = found["top.md"]
    assert (top.summary, top.topic, top.data_id, top.keywords, top.backlinks, top.content) == ("Top", "top", "", ["x", "y"], ["b"], "see [[b]]")
    assert (found["a/deep/two.md"].summary, found["a/deep/two.md"].data_id, found["a/deep/two.md"].data_type) == ("two", "a", "OBSIDIAN")
