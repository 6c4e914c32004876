import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tabloom.llm import mixing, quality
from tests.llm.test_native import fit_by_hand, mixing_u

WORDS = "the of and river mountain slowly carried stones along its bed until winter came over hills".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda: "\n".join(" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 25))) + "." for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        text = prose() if good else prose().upper().replace(" ", "!! ")
        rows.append((i, "Cookie notice\n" + text if good and i % 2 else text, ["en", "fr"][i % 5 == 0], f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in (1, 2, 3, 5)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    rows += [(3000, rows[7][1].replace(rows[7][1].split()[9], "other", 1), "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def near_groups(texts):
    """For each text the first of its group, by the Jaccard similarity of five-word shingles of all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (len(x & y) >= 0.8 * len(x | y)) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def brute(stage, rows, folder, spark):
    """What the stage makes of rows (dicts in the order of doc_id), in plain Python."""
    if stage == 0:
        docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
        model = quality.fit_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"), quality.hash_mod("doc_id", 4) != 2)
        return [r for r in rows if quality.text_scores(model, [(r["text"] or "").encode()])[0] >= cp.REJECT_BELOW]
    if stage == 1:
        texts = {(r["source"], r["text"] or "") for r in rows}
        pages = Counter(s for s, _ in texts)
        seen = Counter((s, x) for s, t in texts for x in set(t.split("\n")) if x.strip())
        bad = {k for k, n in seen.items() if n >= 5 and n > 0.01 * pages[k[0]]}
        out = []
        for r in rows:
            kept = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad)
            out.append({**r, "text": kept, "n_chars": r["n_chars"] if kept == r["text"] else len(kept)})
        return out
    if stage == 2:
        root = near_groups([r["text"] for r in rows])
        return [r for i, r in enumerate(rows) if root[i] == i]
    shape = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").select("doc_id", mixing.topic_of().alias("topic"))
    topic = {r.doc_id: r.topic for r in shape.collect()}
    cell = [(r["source"], r["lang"], topic[r["doc_id"]]) for r in rows]
    cells = Counter()
    for c, r in zip(cell, rows):
        cells[c] += len((r["text"] or "").split())
    q, p, _ = fit_by_hand(cells, list(mixing.ALPHAS.values()), 12)
    lo, hi = 0.0, 1e6  # the factor at which the expected tokens are KEEP of all, by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(p[c] * min(1, mid * q[c] / p[c]) for c in p if p[c]) < cp.KEEP else (lo, mid)
    return [r for c, r in zip(cell, rows) if not p[c] or mixing_u(r["doc_id"]) < min(1, hi * q[c] / p[c])]


#: Names that operators use for columns of their own.
CLASH = ["topic", "n_tokens", "weight", "prob", "kept", "n_lines", "n_dropped", "fingerprint", "score", "component_id", "h", "k", "id", "t", "label"]


def test_stages_equal_brute_force_and_keep_all_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select(*docs.columns, *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASH])
    sizes = []
    for k, (_, stage) in enumerate(cp.STAGES):
        before = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
        sizes.append(len(before))
        out = stage(spark, docs, folder)
        if k == 4:
            break
        got = sorted((r.asDict() for r in out.collect()), key=lambda r: r["doc_id"])
        assert out.columns == COLUMNS + CLASH and {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
        assert got == brute(k, before, folder, spark)
        docs = spark.createDataFrame(got, out.schema)
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0.7 * sizes[3]
    ends = Counter()
    pieces = {}
    for r in out.collect():
        ends[r.sequence_id] += r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    tokens = Tokenizer.from_file(cp.TOKENIZER[0])
    lengths = {r["doc_id"]: len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before}
    assert {i: sum(n for _, n in x) for i, x in pieces.items()} == lengths and max(ends.values()) <= 1024
    bins = []  # best fit decreasing, all lengths being under 1024 here
    for n in sorted(lengths.values(), reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] + n <= 1024]
        if fit:
            bins[max(fit, key=bins.__getitem__)] += n
        else:
            bins.append(n)
    assert -(-sum(lengths.values()) // 1024) <= len(ends) <= len(bins)


def test_the_pipeline_takes_effect(spark, folder):
    seen = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert not {i for i in range(0, 240, 4)} & ids and not ids & {1001, 1002, 1003, 1005, 3000}
    assert len({i for i in range(240) if i % 4} & ids) > 120 and all(seen[i].text for i in ids if i < 2000)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
