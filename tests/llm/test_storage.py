import pytest

from depsignal.llm import storage


def test_stores_have_the_names_that_arrow_knows(monkeypatch):
    asked = []

    class Files:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return None, uri

    monkeypatch.setattr(storage.fs, "FileSystem", Files)
    for uri in ("s3a://lake/a b", "hdfs://name/x", "file:///tmp/x"):
        storage.opened(uri)
    assert asked == ["s3://lake/a b", "hdfs://name/x", "file:///tmp/x"]


def test_unknown_stores_are_refused_at_the_start(monkeypatch):
    for path, fine in (("/tmp/x", True), ("s3a://lake/x", True), ("file:/tmp/x", True), ("dbfs:/x", False)):
        monkeypatch.setattr(storage, "scratch_path", lambda spark, name, path=path: path)
        if fine:
            assert storage.shared_folder(None, "x") == path
        else:
            with pytest.raises(ValueError, match="dbfs"):
                storage.shared_folder(None, "x")
