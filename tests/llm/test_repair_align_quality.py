"""Conversation repair, tokenizer alignment and text quality on small tables, with plain loops as the judge."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushgate.llm import alignment, quality, repair
from hushgate.llm.packing import byte_ranks
from hushgate.llm.queries import byte_bpe_path, piece_bpe_path, quality_held_out
from tests.llm.test_operators import doc_table, nothing, odd, sha, words  # noqa: F401

# ---- conversation repair -----------------------------------------------------


def fast(rows):
    got = []
    r = repair.Repair(lambda e, n, out: got.append((e * n, out)))
    for x in rows:
        r.add(*x)
    cost = r.finish()
    return cost, "".join(e for e, _ in got), tuple(o for _, o in got if o)


def all_repairs(rows, most_inserted=3):
    """Every way to a well-formed conversation; the least is the answer."""
    out = []

    def go(i, state, cost, audit, said, inserted):
        if i == len(rows) and state in (repair.START, repair.AFTER_A):
            out.append((cost, audit, said))
        new = repair.WANTED[state]
        to = repair.NEXT[state][new]
        if inserted < most_inserted:
            go(i, to, cost + 5, audit + "I", (*said, (repair.ROLES[new], "")), inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, state, cost + 2, audit + "D", said, inserted)
            if fault in (repair.SOUND, repair.CUT):
                more = 5 * (fault == repair.CUT)
                if role[:1] in repair.NEXT[state]:
                    go(i + 1, repair.NEXT[state][role[:1]], cost + more, audit + "K", (*said, (role, text)), inserted)
                go(i + 1, to, cost + 1 + more, audit + "R", (*said, (repair.ROLES[new], text)), inserted)

    go(0, repair.START, 0, "", (), 0)
    return min(out)


def by_whole_texts(rows):
    """The same with the whole audit of each state compared as text."""
    best = {repair.START: (0, "", ())}
    for row in [None, *rows]:
        new = {} if row else dict(best)

        def offer(state, value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value
                return True

        for state, (cost, audit, said) in best.items() if row else ():
            role, text, fault = row
            offer(state, (cost + 2, audit + "D", said))
            if fault in (repair.SOUND, repair.CUT):
                more = 5 * (fault == repair.CUT)
                if role[:1] in repair.NEXT[state]:
                    offer(repair.NEXT[state][role[:1]], (cost + more, audit + "K", (*said, (role, text))))
                w = repair.WANTED[state]
                offer(repair.NEXT[state][w], (cost + 1 + more, audit + "R", (*said, (repair.ROLES[w], text))))
        while any([offer(repair.NEXT[s][repair.WANTED[s]], (c + 5, a + "I", (*o, (repair.ROLES[repair.WANTED[s]], ""))))
                   for s, (c, a, o) in list(new.items())]):
            pass
        best = new
    return min(best[s] for s in (repair.START, repair.AFTER_A) if s in best)


def test_repairs_are_the_cheapest_and_first():
    r = random.Random(5)
    for k in range(900):
        roles = ["user", "assistant", "system", "tool", ""] if k % 3 else ["user", "assistant"]
        rows = [(r.choice(roles), str(i), r.choice([0, 0, 0, 1, 2, 3] if k % 2 else [0, 3, 3])) for i in range(r.randrange(5 if k < 200 else 40))]
        assert fast(rows) == by_whole_texts(rows)
        if k < 200:
            assert fast(rows)[:2] == all_repairs(rows)[:2]


def test_only_the_undecided_is_held():
    """Rows that decide each other, and endless deletions, take the same memory however many there are."""
    def held(n, row):
        r = repair.Repair(lambda e, c, out: None)
        tracemalloc.start()
        for i in range(n):
            r.add(*row(i))
        used = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        return used

    chance = random.Random(2)
    mixed = lambda i: (chance.choice(["user", "assistant"]), "t" * 50, chance.choice([0, 0, 0, 1, 3]))
    for row in (mixed, lambda i: ("user", "x", repair.BLANK)):
        assert held(20_000, row) < 2 * held(200, row) + 20_000


def damaged(rows):
    """Conversations after damage by plain Python; rows are (conv_id, turn, role, text)."""
    import zlib

    out = []
    for c, t, role, text in rows:
        blank = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = "user" if kind == 4 else blank(role), blank(text)
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_conversations_of_odd_rows(spark):
    r = random.Random(11)
    rows = []
    for c in [*range(40), None]:
        for t in range(r.randrange(1, 30)):
            for _ in range(1 + (r.random() < 0.1)):
                text = r.choice(["Hi.", "Yes!", "no", "", " \n", None, "é?", "So it is. "]) if r.random() < 0.5 else f"t{r.randrange(30)}."
                rows.append((c, None if r.random() < 0.05 else t * (1 + (c or 0) % 3), r.choice(["user", "assistant", "system", None, ""]), text))
    rows += [(77, 0, "user", "long " * 100_000 + "."), (77, 1, "assistant", "Ok."), (78, 0, "user", "a."), (78, 0, "user", "a.")] * 2
    table = spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, cost string, _fault int").repartition(5)
    broken = repair.damage(table)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])
    assert sorted(map(tuple, broken.collect()), key=str) == sorted(damaged(rows), key=str)
    got = {x.conv_id: x for x in repair.repair_conversations(broken).collect()}
    for conv in {x[0] for x in damaged(rows)}:
        seen, told, turns = set(), [], sorted((x for x in damaged(rows) if x[0] == conv), key=key)
        for _, _, role, text in turns:
            ink = text.rstrip(repair.BLANKS)
            fault = repair.BLANK if not ink else repair.REPEATED if (role, text) in seen else repair.SOUND if ink[-1] in ".!?" else repair.CUT
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, said = by_whole_texts(told)
        numbers = {x[1] for x in turns if x[1] is not None}
        counts = Counter(f for _, _, f in told)
        want = (conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, counts[1], counts[2], counts[3],
                sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(told, told[1:])), cost, audit,
                sha("\n".join(f"{a}:{b}" for a, b in said)))
        assert tuple(got[conv]) == want
    assert repair.repair_conversations(table.filter("false")).count() == 0


# ---- tokenizer alignment -----------------------------------------------------


def plain_alignment(texts):
    a_of, b_of = Tokenizer.from_file(byte_bpe_path()), sentencepiece.SentencePieceProcessor(model_file=piece_bpe_path())
    a_of.encode_special_tokens = True
    spelt_a = {i: t for t, i in byte_ranks(a_of.get_vocab()).items()}
    spell_b = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for text in texts:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        x, y = [spelt_a[i] for i in a], [spell_b(i) for i in b]
        groups = []
        if text and b"".join(x) == b"".join(y) == (" " + text).encode():
            ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
            ea, eb = ends(x), ends(y)
            start = 0
            for cut in sorted(set(ea) & set(eb)):
                groups.append(([i for i, e in zip(a, ea) if start < e <= cut], [i for i, e in zip(b, eb) if start < e <= cut]))
                start = cut
        docs.append(groups)
    links = [Counter((i, j) for g in groups for i in g[0] for j in g[1]) for groups in docs]
    count = Counter(p for c in links for p in c)
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    return [(sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()),
             sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
             sha(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)) if groups else "") for groups, c in zip(docs, links)]


@pytest.mark.parametrize("frequent", [1 << 16, 5])
def test_alignment_equals_plain_loops(spark, monkeypatch, frequent):
    """Odd texts, and the same result whether pairs are looked up in the task or by a join."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 30)
    texts = ["", None, "a", " two  blanks ", "\t\n", "<|endoftext|> </s> <s> <0x41>", "a ▁ b", "é ß 日本 😀" * 3, "!" * 60, "x" * 300, "a\0b",
             words(1, 200), words(1, 200), words(2, 150), "The Quick brown", "ﬁ ① ½ é ﻿", " " * 3000 + "x"]
    ids = [*range(len(texts) - 2), None, None]
    got = alignment.align_documents(doc_table(spark, texts, ids), byte_bpe_path(), piece_bpe_path()).collect()
    want = [(i, *w) for i, w in zip(ids, plain_alignment([t or "" for t in texts]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(g.n_links == 0 for g in got) and any(g.n_best < g.n_links for g in got)


def test_alignment_of_an_endless_run_of_blanks_and_of_nothing(spark, odd, nothing):  # noqa: F811
    enc = alignment.Encoders(byte_bpe_path(), piece_bpe_path())
    a, b = enc.tokens([" " * 1_000_000 + "x"])
    assert len(a[0]) and int(np.asarray(alignment._ends(a, enc.length_a)[2])[-1]) == 1_000_002
    assert alignment.align_documents(nothing, byte_bpe_path(), piece_bpe_path()).count() == 0
    got = alignment.align_documents(odd, byte_bpe_path(), piece_bpe_path())
    assert got.count() == odd.count() and got.columns[0] == "doc_id"


# ---- quality -------------------------------------------------------------------


def labelled(spark, n=600):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        body = words(i, r.randrange(20, 120), 300)
        lines = body.split(" ")
        good = ". ".join(" ".join(lines[k: k + 9]).capitalize() for k in range(0, len(lines), 9)) + "."
        junk = r.choice([" | ".join(lines), body.upper() + "!!" * 9, " ".join(w + "$%" for w in lines), "\n".join(["buy now"] * 20)])
        texts.append(junk if bad else good)
        labels.append((i, int(not bad)))
    return doc_table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_documents_it_has_not_seen(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels.filter(~quality_held_out()))
    got = quality.score(docs, model).join(labels, "doc_id").filter(quality_held_out()).collect()
    good, bad = ([x.score for x in got if x.quality == q] for q in (1, 0))
    assert len(bad) > 20 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.97 and np.mean([s < quality.THRESHOLD for s in bad]) > 0.8
    twice = quality.train(docs.repartition(7), labels.filter(~quality_held_out()).repartition(3))
    assert twice.intercept == model.intercept and np.array_equal(twice.tables, model.tables)


def test_pairs_explain_what_features_alone_cannot():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_model(x, y)
    assert m.pairs[0] == (0, 1) and ((m.score(x) > 0.5) == y).mean() > 0.95
    one = quality.fit_model(x, (x[:, 2] > 0.3).astype(float))
    assert ((one.score(x) > 0.5) == (x[:, 2] > 0.3)).mean() > 0.97


def test_quality_of_odd_rows_and_odd_labels(spark, odd, nothing):  # noqa: F811
    docs, labels = labelled(spark, 120)
    more = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7), (3, 0), (3, 1)], "doc_id long, quality int"))
    model = quality.train(docs, more.withColumn("k", F.lit(1)).withColumn("y", F.lit(2)))
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "score"] and got.count() == odd.count() and got.filter("score between 0 and 1").count() == odd.count()
    blank = {x.score for x in got.filter("doc_id in (0, 1)").collect()}
    assert len(blank) == 1
    assert quality.score(nothing, model).count() == 0
    assert quality.train(docs, labels.filter("false")).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert quality.train(docs, labels.filter("quality = 1")).score(np.zeros((1, len(quality.FEATURES))))[0] > 0.99
    assert quality.train(nothing, labels).tables is None
    assert len(quality.features("")) == len(quality.FEATURES)
