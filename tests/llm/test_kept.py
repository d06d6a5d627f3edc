"""What Python workers keep between tasks, and words encoded apart against whole texts."""

import random

import numpy as np

from hushgate.llm import common, packing, secretscan, toxicity
from hushgate.llm.queries import byte_bpe_path


def _step(module):
    def run(batches):
        yield from batches
    run.__module__ = module
    return common.tidy(run)


def test_a_step_of_another_module_frees_what_was_kept():
    packing.encoder(byte_bpe_path())
    list(_step("hushgate.llm.packing")(iter(())))
    assert common.kept_by("hushgate.llm.packing")
    list(_step("hushgate.llm.toxicity")(iter(())))
    assert not common.kept_by("hushgate.llm.packing")


def test_words_encoded_apart_are_those_of_the_whole_text():
    pick, parts = random.Random(3), ["a", "Bc", "x1", "é", " ", " ", " ", "\n", "\t", ".", "!?", "  ", "\r", "\x1c", "'s"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 20))) for _ in range(3000)] + ["a\tb  c", "a\t \tb", " ", "\n", ""]
    enc = packing.encoder(byte_bpe_path())
    whole = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == whole


def test_plain_texts_are_told_without_a_search(monkeypatch):
    class Searched(Exception):
        pass

    class Never:
        def search(self, _):
            raise Searched

    enc = packing.encoder(byte_bpe_path())
    monkeypatch.setattr(packing, "_RUN", Never())
    assert enc._parts("one two\nthree") == ["one", "two", "\nthree"]


def test_texts_with_accents_are_told_without_a_search(monkeypatch):
    monkeypatch.setattr(packing, "_RUN", None)
    enc = packing.encoder(byte_bpe_path())
    assert enc._parts("zw\u00f6lf \u65e5\u672c\nein") == ["zw\u00f6lf", "\u65e5\u672c", "\nein"]


def test_the_encoder_merges_distinct_words_at_once_and_keeps_none():
    class Counted:
        def __init__(self, bpe):
            self.bpe, self.texts = bpe, []

        def encode_to_numpy(self, text, **kwargs):
            self.texts.append(text)
            return self.bpe.encode_to_numpy(text, **kwargs)

    enc = packing.Encoder(byte_bpe_path())
    enc.bpe = counted = Counted(enc.bpe)
    before = {k: len(v) for k, v in vars(enc).items() if isinstance(v, (dict, list))}
    texts = [f"head word{i % 7} word{i % 7}, \u00e9t\u00e9\nline{i % 5} end." for i in range(500)]
    whole = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == whole
    assert len(counted.texts) == 4 and sum(t.count("word") for t in counted.texts) == 2 * 14
    assert {k: len(v) for k, v in vars(enc).items() if isinstance(v, (dict, list))} == before


def test_odd_white_space_is_as_in_whole_texts():
    pick = random.Random(5)
    parts = ["a", "Bc", "\u00e9", " ", " ", "\n", ".", "\xa0", "\u3000", "\u2003", "\x85", "\u200b", "\u180e", "\ufeff", "\u4e2d", "\x00", "\x1f"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 20))) for _ in range(3000)]
    enc = packing.encoder(byte_bpe_path())
    whole = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == whole and enc.encode([]) == []


def test_whole_texts_pass_python_in_small_batches(spark):
    """Rows that callers write themselves: Arrow batches would be bounded by the session's settings alone."""
    docs = spark.createDataFrame([(1, "password = hunter2hunter2", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, n string")
    model = toxicity.Model(b"ordinary", b"toxic", (0.0,) * 8)
    clean, kept = secretscan.redact(docs, b"identifier"), toxicity.reject(docs, model, threshold=0.6)
    for rows in (clean, kept):
        assert "InArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in clean.collect()} == {(1, "[SECRET]", "x"), (2, None, "y"), (None, "", "z")}
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect()}
    assert toxicity.reject(docs, model, threshold=0.5).count() == 0


def test_a_row_function_makes_its_own_once_and_frees_what_others_kept():
    packing.encoder(byte_bpe_path())
    made = []
    get = common.once_a_task("hushgate.llm.secretscan", lambda: made.append(1) or "it")
    assert common.kept_by("hushgate.llm.packing")
    assert [get(), get()] == ["it", "it"] and made == [1]
    assert not common.kept_by("hushgate.llm.packing")
