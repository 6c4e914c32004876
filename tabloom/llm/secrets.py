"""Operator 11: secrets in texts, told from copied examples by how many repositories and owners hold them (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import hot_join, materialize, text_or_empty

#: Kinds that are always spans: their patterns, which group is the value, and the least length of it. Letters of a name may be of either case.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # a shorter run has no longer part, so the least length can stand in the pattern
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Kinds that are candidates only: they become spans where their ownership says that they are live.
WIDER = {
    "issued": (r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|AIza|npm_|eyJ)[A-Za-z0-9_.-]{16,}", 0, 16),
    "mixed": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
KINDS = [*BASE, *WIDER]

#: A value held by so many owners, or so many repositories, is an example that people copy.
COPIED_OWNERS, COPIED_REPOS = 3, 6
#: What shows that a value is a stand-in, whoever holds it.
STAND_IN = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|test|0123456789|abcdef012|(.)\1{5}"
#: A live-looking value has so many different characters, and letters as well as digits.
LEAST_DIFFERENT = 8
_CHUNK = 256


def running_sums(sizes: Column) -> Column:
    """Sums of the first 1, 2, ... of an array of integers. Chunks of 256 are summed alone, so that appending costs n^1.5 at most."""
    zero = F.array(F.lit(0).cast("long"))

    def sums(a: Column) -> Column:
        """0 and the running sums."""
        return F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))

    def bound(value: Column, body) -> Column:
        """body(value), with value worked out once and not again in each inner function."""
        return F.get(F.transform(F.array(value), body), 0)

    def joined(chunks: Column) -> Column:
        before = sums(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)))
        return bound(before, lambda b: F.flatten(F.transform(chunks, lambda c, i: bound(F.get(b, i), lambda base: F.transform(F.slice(c, 2, _CHUNK), lambda x: x + base)))))

    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int"))
    chunks = F.transform(starts, lambda i: sums(F.slice(sizes, i * _CHUNK + 1, _CHUNK)))
    return F.when(F.size(sizes) > 0, bound(chunks, joined)).otherwise(F.array().cast("array<bigint>"))


def with_spans(df: DataFrame, text: str, kind: str, out: str, rest: str | None = None) -> DataFrame:
    """Add `out`: array of (start, no, end, value), the leftmost non-overlapping matches of a kind, in code points, that are long enough.
    With `rest`, add the text with blanks in place of those matches. Texts without a match are only searched once."""
    pattern, group, least = (BASE | WIDER)[kind]
    hit, p = F.col("__hit"), F.lit(pattern)
    df = df.withColumn("__hit", F.col(text).rlike(pattern))
    df = df.withColumn("__found", F.when(hit, F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__between", F.when(hit, F.split(text, pattern, -1)).otherwise(F.array(F.col(text))))
    pairs = F.zip_with(F.slice("__between", 1, F.size("__found")), "__found", lambda b, m: (F.length(b) + F.length(m)).cast("long"))
    df = df.withColumn("__ends", running_sums(pairs))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    spans = F.zip_with(
        "__ends", "__found", lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("no"), e.alias("end"), value(m).alias("value"))
    )
    df = df.withColumn(out, F.filter(spans, lambda s: F.length(s["value"]) >= least))
    if rest:
        cleared = F.zip_with("__between", "__found", lambda b, m: F.concat(b, F.when(m.isNull(), "").when(F.length(value(m)) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)))
        df = df.withColumn(rest, F.when(hit, F.array_join(cleared, "")).otherwise(F.col(text)))
    return df.drop("__hit", "__found", "__between", "__ends")


def candidates(docs: DataFrame, text: str, owner: Column, repo: Column, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with a row number, owner, repository, base spans and wider candidates, without texts; materialized."""
    df = docs.select(*[F.col(c) for c in keep], F.coalesce(owner.cast("string"), F.lit("")).alias("__owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("__repo"), text_or_empty(text).alias("__text"))
    for kind in BASE:
        df = with_spans(df, "__text", kind, f"__{kind}")
    df = df.withColumn("__cleared", F.col("__text"))
    for kind in BASE:
        df = with_spans(df, "__cleared", kind, "__again", rest="__cleared").drop("__again")
    df = with_spans(df, "__cleared", "issued", "__issued", rest="__cleared")
    df = with_spans(df, "__cleared", "mixed", "__mixed")
    mixed = F.filter("__mixed", lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]"))
    hashed = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["no"], s["end"], F.sha2(s["value"], 256).alias("hash"), looks_live(s["value"]).alias("lively")))
    spans = F.array_sort(F.concat(*[hashed(f"__{k}") for k in BASE]))
    wider = F.array_sort(F.concat(hashed("__issued"), hashed(mixed)))
    return materialize(df.select(*keep, "__owner", "__repo", spans.alias("__spans"), wider.alias("__wider")).withColumn("__row", F.monotonically_increasing_id()))


def looks_live(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return ~value.rlike(STAND_IN) & (different >= LEAST_DIFFERENT) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repos, owners, verdict, rows of candidates (hash, lively, __owner, __repo). `example`: looks like a stand-in or is held by
    COPIED_OWNERS owners or COPIED_REPOS repositories; `live`: of one owner; `shared`: between them.

    Counted by (hash, owner, repository) and then (hash, owner) first, so that a value of very many rows is summed where they lie.
    """
    each = found.groupBy("hash", "__owner", "__repo").agg(F.count("*").alias("rows"), F.max("lively").alias("lively"))
    owners = each.groupBy("hash", "__owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"), F.max("lively").alias("lively"))
    sums = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("rows").alias("rows"), F.max("lively").alias("lively"))
    copied = ~F.col("lively") | (F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS)
    return sums.select("hash", "repos", "owners", F.when(copied, "example").when(F.col("owners") == 1, "live").otherwise("shared").alias("verdict"), "rows")


def scan(docs: DataFrame, text: str = "text", owner: str | Column = "source", repo: str | Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with the array `secrets` of (start, no, end, hash, repos, owners, verdict), by start: every
    base span (KINDS of `no`; see BASE), and those wider candidates (WIDER, looked for outside base spans) whose value is `live`.

    A value's sha256 is counted over the whole corpus: distinct repositories and owners. Widely copied values and stand-ins are
    examples; a live-looking value of a single owner is live. A repository is (owner, lang-like column) or what `repo` says.

    Null texts are empty and have none; null owners or repositories are one of their own; repeated rows are the same repository and each get
    their spans; an empty table gives none; a value in a third of all rows is counted where its rows lie and meets them by
    broadcast (hot_join). Columns named like those made here (they begin with two underscores) or secrets are not allowed in keep.
    """
    keep = docs.columns if keep is None else keep
    if clash := [c for c in keep if c.startswith("__") or c == "secrets"]:
        raise ValueError(f"rename {clash}")
    owner = F.col(owner) if isinstance(owner, str) else owner
    repo = owner if repo is None else F.col(repo) if isinstance(repo, str) else repo
    rows = candidates(docs, text, owner, repo, keep)
    found = materialize(rows.where((F.size("__spans") > 0) | (F.size("__wider") > 0)).select("__row", "__owner", "__repo", F.explode(F.concat("__spans", "__wider")).alias("s")).select("__row", "__owner", "__repo", "s.*"))
    known = materialize(ownership(found))
    judged = hot_join(found, known, ["hash"], "rows").where((F.col("no") < len(BASE)) | (F.col("verdict") == "live"))
    span = F.struct("start", "no", "end", "hash", "repos", "owners", "verdict")
    spans = judged.groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("secrets"))
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,hash:string,repos:bigint,owners:bigint,verdict:string>>")
    return rows.select(*keep, "__row").join(spans, "__row", "left").select(*keep, F.coalesce("secrets", empty).alias("secrets"))


def document_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repo: str | Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example (base and added spans by verdict)."""
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(owner) if isinstance(owner, str) else owner).alias("owner"), (F.lit(None).cast("string") if repo is None else F.col(repo) if isinstance(repo, str) else repo).alias("repo"))
    out = scan(chosen, "text", "owner", "owner" if repo is None else "repo", keep=["doc_id"])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["no"]), s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["no"] < len(BASE))
    count = lambda field, value: F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long")
    counts = [count("no", i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    verdicts = [count("verdict", v).alias(f"n_{v}") for v in ("live", "example")]
    return out.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named("secrets").alias("spans"), *verdicts)


def oracle() -> str:
    """The registered query's rows (owner: source; repository: source and lang) by DuckDB: a row per match, places from window sums."""

    def matched(kind: str, text: str, source: str) -> str:
        pattern, group, least = (BASE | WIDER)[kind]
        if kind == "assign":
            either = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
            pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join([*either.values(), "[aA][pP][iI]_?[kK][eE][yY]"]))
        p = pattern.replace("'", "''")
        return f"""select id, {KINDS.index(kind)} as no, m, sum(length(b) + length(m)) over (partition by id order by i) as e, regexp_extract(m, '{p}', {group}) as v, {least} as least
            from (select id, unnest(regexp_extract_all({text}, '{p}')) as m, unnest(string_split_regex({text}, '{p}')[:-2]) as b, generate_subscripts(regexp_extract_all({text}, '{p}'), 1) as i from {source})"""

    steps = []
    steps.append("docs as (select row_number() over () as id, doc_id, coalesce(source, '') as o, coalesce(source, '') || '/' || coalesce(lang, '') as r, coalesce(text, '') as t from documents)")
    for k in BASE:
        steps.append(f"{k} as (select id, no, (e - length(m))::bigint as s, e::bigint as e, v from ({matched(k, 't', 'docs')}) where length(v) >= least)")
    # a match that is long enough becomes blanks: the text is put together again from what lies between the matches
    steps.append("c0 as (select id, t from docs)")
    for i, k in enumerate([*BASE, "issued"], 1):
        if k == "issued":
            steps.append(f"issued as (select id, no, (e - length(m))::bigint as s, e::bigint as e, v from ({matched(k, 't', f'c{i - 1}')}))")
        gone = matched(k, "t", f"c{i - 1}")
        steps.append(f"g{i} as (select id, list((e - length(m))::bigint order by e) as ss, list(e::bigint order by e) as es from ({gone}) where length(v) >= least group by id)")
        steps.append(f"""c{i} as (select c.id, case when g.id is null then t else array_to_string(list_transform(range(1, len(ss) + 1), lambda j: t[case when j = 1 then 1 else es[j - 1] + 1 end:ss[j]] || repeat(' ', es[j] - ss[j])), '') || t[es[len(es)] + 1:] end as t
            from c{i - 1} c left join g{i} g on c.id = g.id)""")
    steps.append(f"""mixed as (select id, no, (e - length(m))::bigint as s, e::bigint as e, v from ({matched('mixed', 't', 'c4')})
        where regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]'))""")
    steps.append("found as (" + " union all ".join(f"select * from {k}" for k in KINDS) + ")")
    stand_in = STAND_IN.replace(r"|(.)\1{5}", "")
    repeated = "list_has_any(list_transform(range(1, length(v) + 1), lambda i: length(v) - i >= 5 and v[i:i + 5] = repeat(v[i], 6)), [true])"
    lively = f"not regexp_matches(v, '{stand_in}') and not {repeated} and len(list_distinct(string_split(v, ''))) >= {LEAST_DIFFERENT} and regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]')"
    steps.append(f"""verdicts as (select v, case when not ({lively}) or count(distinct o) >= {COPIED_OWNERS} or count(distinct r) >= {COPIED_REPOS} then 'example' when count(distinct o) = 1 then 'live' else 'shared' end as verdict
        from found join docs using (id) group by v)""")
    steps.append(f"judged as (select f.*, verdict from found f join verdicts using (v) where no < {len(BASE)} or verdict = 'live')")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    named = f"string_agg({names}[no + 1] || ':' || s || ':' || e, ',' order by s, no)"
    counts = ", ".join(f"count(*) filter (no = {i}) as n_{k}" for i, k in enumerate(BASE))
    steps.append(f"sums as (select id, {counts}, {named} filter (no < {len(BASE)}) as base, {named} as spans, count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example from judged group by id)")
    each = ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)
    return f"with {', '.join(steps)} select doc_id, {each}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from docs left join sums using (id)"
