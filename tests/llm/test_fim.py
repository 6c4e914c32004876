"""Operator 12 against a plain reading of its rule, and its round trip."""

from __future__ import annotations

import hashlib
import random
import re

from tabloom.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    hex_ = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, output = "plain", text
    elif h[3] % 100 < 80:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sizes = (None, None) if form == "plain" else (len(prefix), len(middle))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, *sizes, output, sha(output), sha(text)


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    parts = ["a", "é", "😀b", "日本", " ", "\t", "\n\n", "\x0b", "\x00", "\xa0", "<", "<S", "P>", ">", "M", "é", "it's", "'"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(None, "a b c"), (5, None), (6, ""), (7, " \n "), (8, "x <P> y"), (9, "a" * 300_000), (-3, "neg ative"), (11, "word " * 200_000), (3, "same same"), (3, "same same"), (2**62, "large id")]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, n int, middle string").repartition(3)
    for at_once in (fim.AT_ONCE, 500):
        got = sorted(map(str, map(tuple, fim.fill_in_middle(docs, at_once=at_once).collect())))
        assert got == sorted(str(brute(*r)) for r in rows)
    forms = {brute(*r)[2] for r in rows}
    assert forms == {"plain", "psm", "spm"}


def test_empty_and_rates(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fim.fill_in_middle(docs, rate=100, spm=0).collect()} == {"psm"} and {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
