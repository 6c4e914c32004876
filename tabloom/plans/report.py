"""The report: eleven sections from the artifacts, as Markdown and as a plain PDF."""

from __future__ import annotations

import csv
import json
import re
import textwrap
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.ordering import best_per_group
from tabloom.sources import files

SECTIONS = ("Cover", "Dataset", "Exploration", "Metric", "Features", "Model selection", "Cross-validation", "Validation", "Narrative", "Outputs", "Limitations")
# What a display shows for a missing value.
NOT_KNOWN = ("", "na", "nan", "none", "null", "n/a")


def shorten(x, most: int = 80) -> str:
    s = show(x)
    return s if len(s) <= most else s[: most - 1] + "…"


def show(x) -> str:
    """A value for readers: four significant digits, lists with commas, mappings as JSON, a dash for nothing."""
    if x is None or (isinstance(x, float) and x != x):
        return "-"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, float):
        return f"{x:.4g}"
    if isinstance(x, (list, tuple)):
        return compact(x)
    if isinstance(x, dict):
        return json.dumps(files.plain(x), ensure_ascii=False)
    return str(x)


def compact(items: Sequence, most: int = 8) -> str:
    shown = ", ".join(show(x) for x in items[:most])
    return shown + (f" and {len(items) - most} more" if len(items) > most else "") if items else "-"


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def display_columns(rows: Sequence[dict]) -> list[str]:
    """Columns that hold something to show in any row."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return [c for c in names if any(str(show(r.get(c))).strip().lower() not in (*NOT_KNOWN, "-") for r in rows)]


def shown_columns(df: DataFrame) -> list[str]:
    """display_columns() of a whole table, in one aggregate."""
    if not df.columns:
        return []
    text = lambda c: F.lower(F.trim(F.col(f"`{c}`").cast("string")))
    found = df.agg(*[F.bool_or(F.coalesce(~text(c).isin(*NOT_KNOWN, "-"), F.lit(False))) for c in df.columns]).first()
    return [c for c, there in zip(df.columns, found) if there]


def table(rows: Sequence[dict], most: int = 20) -> list[str]:
    if not rows:
        return ["(no rows)"]
    names = display_columns(rows)
    out = ["| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
    out += ["| " + " | ".join(shorten(r.get(c), 40).replace("|", "/") for c in names) + " |" for r in rows[:most]]
    return out + ([f"({len(rows) - most} more rows)"] if len(rows) > most else [])


def strategy_comparison(cv: DataFrame) -> DataFrame:
    """One row per strategy, the better first."""
    return cv.where("status = 'strategy_summary'").select("strategy", "strategy_score", "is_selected").orderBy(F.col("strategy_score").asc_nulls_last(), "strategy")


def global_comparison(cv: DataFrame, most: int = 8) -> DataFrame:
    """The best global candidates."""
    rows = cv.where("strategy = 'global' AND status = 'ok'")
    return rows.select("model", "model_family", "score_mean", "score_std", "mae_mean", "is_selected").orderBy("score_mean", "model").limit(most)


def selected_per_block(cv: DataFrame) -> DataFrame:
    """Each block's best row."""
    rows = cv.where("strategy = 'per_block' AND score_mean IS NOT NULL AND block NOT IN ('__strategy__', '__all__')")
    return best_per_group(rows, "block", "score_mean", ["model"]).select("block", "model", "score_mean", "status").orderBy("block")


def cv_display(cv: DataFrame, most: int = 40) -> DataFrame:
    """Rows to show: each block's three best, or the candidates of the global strategy."""
    w = Window.partitionBy("strategy", "block").orderBy(F.col("score_mean").asc_nulls_last(), "model")
    rows = cv.where("status <> 'strategy_summary'").withColumn("rank", F.row_number().over(w))
    return rows.where("strategy = 'global' OR rank <= 3").select("strategy", "block", "model", "status", "score_mean", "score_std", "is_selected").orderBy("strategy", "block", "rank").limit(most)


def prediction_facts(submission: DataFrame, target: str) -> DataFrame:
    x = F.col(f"`{target}`").cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return submission.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(good, 1)).alias("finite"), F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias("not_finite"))


def context(root: str | Path) -> dict:
    """All artifacts that are there."""
    out = Path(root) / "artifacts"
    eda = {p.stem: _read_table(p) for p in sorted((out / "eda").glob("*.csv"))}
    return {
        "schema": files.read_json(out / "schema_summary.json"), "modeling": files.read_json(out / "modeling_log.json"), "validation": files.read_json(out / "validation_report.json"),
        "eda_summary": files.read_json(out / "eda" / "eda_summary.json"), "eda": eda, "cv": _read_table(out / "cv_results.csv"), "log": files.read_json(out / "pipeline_run_log.json"),
    }


def _read_table(path: Path) -> list[dict]:
    if not path.is_file():
        return []
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def sections(c: dict) -> list[tuple[str, list[str]]]:
    """(title, lines) of each section."""
    schema, log, val = c["schema"], c["modeling"], c["validation"]
    metric, join = schema.get("metric", {}), schema.get("join", {})
    item = lambda k, v: f"- {k}: {show(v)}"
    body = {
        "Cover": ["Automatic analysis and prediction report", "", item("data", schema.get("data_dir")), item("validation", val.get("status")), item("strategy", log.get("strategy"))],
        "Dataset": [*table([{"file": f["rel_path"], "role": f["role"], "rows": f["n_rows"], "columns": f["n_cols"]} for f in schema.get("files", [])]), "", item("training keys", join.get("train_keys")), item("prediction keys", join.get("predict_keys")), *[f"- {w}" for w in schema.get("warnings", [])]],
        "Exploration": [line for name, rows in c["eda"].items() for line in (f"{name}:", *table(rows, 12), "")],
        "Metric": [item("metric", metric.get("metric_name")), item("mode", metric.get("metric_mode")), item("block column", metric.get("block_column")), item("blocks", metric.get("block_values")), item("source", metric.get("metric_source")), metric_text(metric)],
        "Features": [item(k, v) for k, v in log.get("feature_groups", {}).items()] + [f"- {n}" for n in log.get("notes", [])],
        "Model selection": [item("strategy", log.get("strategy")), item("score", log.get("score")), item("model", log.get("model")), item("blocks", log.get("blocks"))],
        "Cross-validation": table([{k: r[k] for k in ("strategy", "block", "model", "status", "score_mean", "score_std", "is_selected")} for r in c["cv"]], 40),
        "Validation": [item("status", val.get("status")), *[f"- error: {e}" for e in val.get("errors", [])], *[f"- warning: {w}" for w in val.get("warnings", [])]],
        "Narrative": narrative(c),
        "Outputs": [item("submission", log.get("submission")), item("rows", log.get("prediction_rows")), *[item(s.get("step"), s.get("status")) for s in c["log"].get("steps", [])]],
        "Limitations": [*[f"- {n}" for n in sorted({r["notes"] for r in c["cv"] if r.get("notes")})], "- Folds come from the rows' md5, not from a random stream.", "- Scores of blocks that fall back to their median are taken on the rows that they come from."],
    }
    return [(s, body[s]) for s in SECTIONS]


def metric_text(metric: dict) -> str:
    if metric.get("metric_mode") == "block_averaged":
        return "The absolute error is averaged within each block, then over blocks, so that each block counts alike."
    return "The absolute error is averaged over all rows."


def narrative(c: dict) -> list[str]:
    rows = c["eda"].get("missingness", [])
    gaps = [r["column"] for r in rows if float(r.get("missing_pct") or 0) > 0]
    corr, shift = c["eda"].get("top_numeric_correlations", []), c["eda"].get("shift_numeric", [])
    out = [f"{plural(len(gaps), 'column')} {'has' if len(gaps) == 1 else 'have'} missing values ({compact(gaps)})."]
    if corr:
        out.append(f"The strongest linear relation with the target is that of {corr[0]['column']} (|r| {float(corr[0]['abs_corr_with_target']):.3f}).")
    if shift and shift[0].get("standardized_mean_diff"):
        out.append(f"Between training and prediction rows {shift[0]['column']} differs most ({float(shift[0]['standardized_mean_diff']):.2f} deviations).")
    if c["modeling"].get("score") is not None:
        out.append(f"The chosen strategy is {c['modeling'].get('strategy')}, with a cross-validated score of {show(c['modeling']['score'])}.")
    return out


def markdown(c: dict) -> str:
    return "\n".join(line for title, lines in sections(c) for line in (f"## {title}" if title != "Cover" else "# Report", "", *lines, "")) + "\n"


def charts(c: dict) -> list[tuple[str, list[tuple[str, float]]]]:
    """(title, bars) of the exploration's figures: the label and the height of each bar."""
    wanted = [("Missing share by column", "missingness", "column", "missing_pct"), ("Strongest linear relations with the target", "top_numeric_correlations", "column", "abs_corr_with_target"),
              ("Target", "target_histogram", "low", "count"), ("Mean target by block", "target_by_block", "block", "mean_target"), ("Rows by month", "time_summary", "period", "rows")]
    out = []
    for title, name, label, height in wanted:
        rows = [r for r in c["eda"].get(name, []) if r.get(height) not in (None, "")]
        bars = [(shorten(r.get(label) or "-", 14), float(r[height])) for r in rows[:24]]
        if any(h for _, h in bars):
            out.append((title, bars))
    return out


class Canvas:
    """Letter pages that are filled from the top; what doesn't fit goes on the next page."""

    LEFT, RIGHT, TOP, BOTTOM = 54, 558, 734, 54
    FONTS = {"F1": "Helvetica", "F2": "Helvetica-Bold"}

    def __init__(self, title: str):
        self.title, self.pages, self.y = title, [], 0.0
        self.turn()

    def turn(self) -> None:
        self.pages.append([])
        self.y = self.TOP

    def room(self, height: float) -> None:
        if self.y - height < self.BOTTOM:
            self.turn()

    def put(self, op: str) -> None:
        self.pages[-1].append(op.encode("cp1252", "replace"))

    def text(self, x: float, y: float, line: str, size: float = 9.5, font: str = "F1") -> None:
        safe = line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
        self.put(f"BT /{font} {size} Tf {x:.1f} {y:.1f} Td ({safe}) Tj ET")

    def box(self, x: float, y: float, w: float, h: float, grey: float) -> None:
        self.put(f"{grey} g {x:.1f} {y:.1f} {w:.1f} {h:.1f} re f 0 g")

    @staticmethod
    def wrap(line: str, width: float, size: float) -> list[str]:
        """Lines of at most about this width; words that are longer are broken."""
        return textwrap.wrap(line, max(3, int(width / (0.5 * size)))) or [""]

    def heading(self, line: str, size: float = 15) -> None:
        self.room(size + 60)
        self.y -= size + 8
        self.text(self.LEFT, self.y, line, size, "F2")
        self.y -= 8

    def paragraph(self, line: str) -> None:
        bullet = line.startswith("- ")
        for i, part in enumerate(self.wrap(line[2:] if bullet else line, self.RIGHT - self.LEFT - 12 * bullet, 9.5)):
            self.room(13)
            self.y -= 13
            if bullet and not i:
                self.text(self.LEFT, self.y, "\u2022")
            self.text(self.LEFT + 12 * bullet, self.y, part)

    def table(self, rows: list[list[str]], size: float = 8) -> None:
        """Rows of cells, the first the heading, which is repeated on each page; columns are as wide as their contents ask for."""
        asks = [min(32, max(len(r[i]) for r in rows)) + 2 for i in range(len(rows[0]))]
        widths = [(self.RIGHT - self.LEFT) * a / sum(asks) for a in asks]
        self.y -= 6

        def row(cells: list[str], head: bool) -> None:
            parts = [self.wrap(x, w - 6, size * 1.05) for x, w in zip(cells, widths)]
            height = max(map(len, parts)) * (size + 2) + 4
            if self.y - height < self.BOTTOM and not head:
                self.turn()
                row(rows[0], True)
            self.y -= height
            if head:
                self.box(self.LEFT, self.y, self.RIGHT - self.LEFT, height, 0.88)
            x = self.LEFT
            for lines, w in zip(parts, widths):
                for k, line in enumerate(lines):
                    self.text(x + 3, self.y + height - (k + 1) * (size + 2), line, size, "F2" if head else "F1")
                x += w
            self.put(f"0.7 G 0.4 w {self.LEFT} {self.y:.1f} m {self.RIGHT} {self.y:.1f} l S 0 G")

        self.room(3 * (size + 6))
        for i, r in enumerate(rows):
            row(r, not i)
        self.y -= 6

    def chart(self, title: str, bars: list[tuple[str, float]], height: float = 120) -> None:
        """Bars from a line at zero, with the greatest and the least value and every label that finds room."""
        self.room(height + 60)
        self.y -= 20
        self.text(self.LEFT, self.y, title, 10, "F2")
        top, floor = self.y - 10, self.y - 10 - height
        hi, lo = max(0.0, *(h for _, h in bars)), min(0.0, *(h for _, h in bars))
        scale, step = height / ((hi - lo) or 1.0), (self.RIGHT - self.LEFT - 50) / len(bars)
        zero = floor - lo * scale
        for i, (label, h) in enumerate(bars):
            x = self.LEFT + 50 + i * step
            self.box(x, min(zero, zero + h * scale), 0.8 * step, abs(h) * scale, 0.45)
            if i % max(1, int(60 / step)) == 0:
                self.text(x, floor - 10, label, 7)
        self.put(f"0.4 w {self.LEFT + 50} {zero:.1f} m {self.RIGHT} {zero:.1f} l S")
        self.text(self.LEFT, top - 7, show(float(hi)), 7)
        self.text(self.LEFT, floor, show(float(lo)), 7)
        self.y = floor - 18

    def bytes(self) -> bytes:
        objects: list[bytes] = []
        add = lambda x: objects.append(x) or len(objects)
        fonts = {k: add(f"<< /Type /Font /Subtype /Type1 /BaseFont /{v} /Encoding /WinAnsiEncoding >>".encode()) for k, v in self.FONTS.items()}
        tree = len(objects) + 2 * len(self.pages) + 1
        used = " ".join(f"/{k} {v} 0 R" for k, v in fonts.items()).encode()
        kids = []
        for k, ops in enumerate(list(self.pages), 1):
            self.pages.append([])  # header and footer are written like any text
            self.text(self.LEFT, 756, self.title, 8)
            self.text(self.RIGHT - 60, 30, f"Page {k} of {len(self.pages) - 1}", 8)
            stream = b"\n".join(ops + self.pages.pop())
            content = add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
            kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Resources << /Font << %s >> >> /Contents %d 0 R >>" % (tree, used, content)))
        add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)))
        root = add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
        out, places = bytearray(b"%PDF-1.4\n"), []
        for k, o in enumerate(objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, start))


def pdf(c: dict) -> bytes:
    """The sections as pages with headings, tables, the exploration's figures, headers and footers. Needs no library."""
    page = Canvas("Automatic analysis and prediction report")
    for k, (title, lines) in enumerate(sections(c)):
        if title == "Cover":
            page.y -= 120
            page.heading(lines[0], 22)
            lines = lines[1:]
        else:
            if k == 1:
                page.turn()
            page.heading(f"{k}. {title}")
        rows: list[list[str]] = []
        for line in [*lines, ""]:
            if line.startswith("|"):
                if not re.fullmatch(r"[| -]+", line):
                    rows.append([x.strip() for x in line.strip().strip("|").split("|")])
                continue
            if rows:
                page.table(rows)
                rows = []
            if line.endswith(":") and not line.startswith("- "):
                page.heading(line[:-1].replace("_", " ").capitalize(), 11)
            elif line:
                page.paragraph(line)
        if title == "Exploration":
            for name, bars in charts(c):
                page.chart(name, bars)
    return page.bytes()


def write_report(root: str | Path) -> Path:
    """report.md and report.pdf below root."""
    c = context(root)
    files.write_text(markdown(c), Path(root) / "report.md")
    path = Path(root) / "report.pdf"
    path.write_bytes(pdf(c))
    return path
