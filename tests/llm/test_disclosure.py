"""Terms that disclose a value with one or two lines, far away on its line, or of few letters."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pgspark.llm import pii
from tests.llm.helpers import docs, sorted_rows


def test_rare_values_and_whole_lines(spark):
    gap = "the weather is fine and people walk along the river " * 3
    texts = [f"Zorblax writes {gap} to jane@corp.com", f"for Kim {gap} mail kim1@home.org", f"call Kim {gap} at kim1@home.org"]
    filler = [f"to call for mail {gap} writes at day" for _ in range(4000)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(docs(spark, texts + filler))).collect()}
    assert ":0:7" in got[0]  # one line, over 150 characters from the value
    assert ":4:7" in got[1] and ":5:8" in got[2]  # two lines, three letters
    assert all(s == "" for i, s in got.items() if i > 2)
    assert got[0].count(",") == 1 and got[1].count(",") == 1  # common words of the lines stay


ADDRESS = re.compile(r"[a-z]+@[a-z]+\.org")


def brute_disclosures(texts, low=0.8, high=0.95, prior=2.0):
    """(entity, term): (pmi, ic, action), counted line by line."""
    n, n_t, n_e, n_et, different = 0, defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for line in (line for t in texts for line in (t or "").split("\n")):
        n += 1
        terms = {w for w in re.findall(r"[a-z0-9]+", line.lower()) if re.search("[a-z]", w)}
        entities = {f"email|{m}" for m in ADDRESS.findall(line.lower())}
        for t in terms:
            n_t[t] += 1
        for e in entities:
            n_e[e] += 1
            for t in terms:
                n_et[e, t] += 1
                different[e, t].add(line)
    out = {}
    for (e, t), k in n_et.items():
        s, ic = len(different[e, t]), math.log2(n / n_e[e])
        pmi = min(ic, math.log2(n * (k / n_t[t] * s / (s + prior)) / n_e[e]))
        if ic > 0 and pmi >= low * ic:
            out[e, t] = (pmi, ic, "removed" if pmi >= high * ic else "term")
    return out


def mentions(seed, n=700):
    r = random.Random(seed)
    names, codes = ["ann", "bob", "cyd", "dee"], ["falcon", "heron", "ibis", "kite", "x9"]
    texts = []
    for _ in range(n):
        lines = []
        for _ in range(r.randrange(1, 4)):
            ws = [r.choice(["the", "sun", "is", "up", "and", "we", "walk", "home"]) for _ in range(r.randrange(3, 9))]
            if r.random() < 0.1:
                k = r.randrange(4)
                ws += [f"{names[k]}@mail.org"] * r.choice([1, 2]) + [codes[k] if r.random() < 0.8 else r.choice(codes)]
                r.shuffle(ws)
            lines.append(" ".join(ws))
        texts.append("\n".join(lines))
    return texts + [texts[0], texts[0], None, ""]


def test_information_against_brute_force(spark):
    texts = mentions(3)
    want = brute_disclosures(texts)
    got = {(r.entity, r.term): (r.pmi, r.ic, r.action) for r in pii.disclosures(docs(spark, texts)).collect()}
    assert set(got) == set(want) and len(want) > 4
    for k, (pmi, ic, action) in want.items():
        assert got[k][:2] == pytest.approx((pmi, ic)) and got[k][2] == action
    # Where the terms stand: in every document that holds the value.
    spans = dict(sorted_rows(pii.digest(pii.find(docs(spark, texts))), "doc_id", "spans"))
    for i, t in enumerate(texts):
        held = {f"email|{m}" for m in ADDRESS.findall(t or "")}
        kinds = defaultdict(set)
        for (e, term), (_, _, action) in want.items():
            if e in held:
                kinds[term].add(action)
        base = [(m.start(), m.end()) for m in ADDRESS.finditer(t or "")]
        found = [(a, 0, b, "email") for a, b in base]
        for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?![A-Za-z0-9])", t or ""):
            if m[0].lower() in kinds and not any(a < m.end() and m.start() < b for a, b in base):
                found.append((m.start(), 4, m.end(), max(kinds[m[0].lower()])))
        assert spans[i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_a_value_that_many_documents_share_grows_linearly(spark, monkeypatch):
    """Each document meets the terms that it has, not all terms of the value."""
    seen = []
    real = pii.materialise
    monkeypatch.setattr(pii, "materialise", lambda df, name: seen.append((name, out := real(df, name))) or out)
    rows = {}
    for n in (60, 240):
        texts = [f"own{i} words{i} of all@corp.org here{i}" for i in range(n)] + ["nothing to see"] * 2 * n
        table = docs(spark, texts)
        base = pii.base_table(table)
        disclosing = pii.disclosures(table, generalise_at=0.0, remove_at=2.0, prior=0.0)
        seen.clear()
        pii.term_spans(table, base, disclosing)
        held = dict(seen)["pii-held"]
        own = held.select(F.explode("entities").alias("entity"), pii._terms(F.col("text")).alias("t")).select("entity", F.explode("t").alias("term"))
        rows[n] = own.join(disclosing, ["entity", "term"]).count()
    assert rows[240] <= 4 * rows[60]
