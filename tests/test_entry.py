import importlib
import sys

import __spark_entry__ as entry


def test_flagship_finds_the_clip(spark):
    best = entry.entry(spark).orderBy("rank").first()
    assert best.track_id == 0 and best.offset_frames == 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sonolith.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith("sonolith.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone, *sys.meta_path])
    again = importlib.reload(entry)
    assert "match_topk_lp" in again.queries() and not any(q.startswith("op1_") for q in again.queries())
    monkeypatch.undo()
    importlib.reload(entry)
