import random
import re

import pytest

from tabloom.llm import licenses


def brute(template, block):
    """Fewest edits from the template to any stretch of the block, by the textbook."""
    same = lambda w, x: bool(re.fullmatch(r"v?\d+(\.\d+)*", x)) if w == "<v>" else w == x
    row = [0] * (len(block) + 1)
    for i, w in enumerate(template, 1):
        new = [i]
        for j, x in enumerate(block, 1):
            new.append(min(row[j - 1] + (not same(w, x)), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_differences_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        t = tuple(rng.choice(["a", "b", "c", "<v>"]) for _ in range(rng.randint(1, 7)))
        b = [rng.choice(["a", "b", "c", "2.0", "d"]) for _ in range(rng.randint(0, 12))]
        assert licenses.differences(t, b)[0] == brute(t, b)


@pytest.mark.parametrize("size", [100, 1_000, 20_000])
def test_every_template_is_found_within_one_line_of_prose(size):
    rng = random.Random(size)
    for name, text in licenses.TEMPLATES:
        prose = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(size)]
        at = rng.randint(0, size)
        got = licenses.scan_text(" ".join(prose[:at] + [text.replace("<v>", "4.0")] + prose[at:]))
        ((license, version, reduction, d, _, confirmed, line, word),) = got
        assert (license, version, d, confirmed, line, word) == (name, "4.0" if "<v>" in text else None, 0, True, 0, at) and reduction > 0


def test_blocks_of_several_licences_lose_none():
    short = "Licensed under the BSD License.\nLicensed under CC BY 4.0."
    assert {r[0] for r in licenses.scan_text(short) if r[5]} == {"BSD", "CC-BY"}
    rng = random.Random(7)
    for n in (2, 3, 4, 14) * 40:
        some = rng.sample([x for x in licenses.TEMPLATES], n)
        for end in ("\n", " "):
            block = end.join(t.replace("<v>", "4.0") for _, t in some)
            got = licenses.scan_text(block)
            assert [(r[0], r[3], r[5]) for r in got] == [(name, 0, True) for name, _ in some], block


def test_every_occurrence_and_version_is_reported():
    gpl = "Licensed under the GNU General Public License, version {}. "
    got = licenses.scan_text(gpl.format(2) + gpl.format(3) + "word " * 500 + gpl.format(3))
    assert [r[:2] + r[6:] for r in got] == [("GPL", "2", 0, 0), ("GPL", "3", 0, 9), ("GPL", "3", 0, 518)]


def test_scan_equals_brute_force_over_all_templates_and_places():
    """All stretches of all templates, found without windows, gate or compression, then taken apart by the same rule of overlaps."""
    rng = random.Random(13)
    for _ in range(25):
        parts = []
        for _, t in rng.choices(licenses.TEMPLATES, k=rng.randint(1, 9)):
            w = t.replace("<v>", rng.choice(["2", "3.0", "v4"])).split()
            for _ in range(rng.choice([0, 0, 1, 2, 7])):
                w[rng.randrange(1, len(w))] = rng.choice(["other", "word", "the"])
            parts += [" ".join(w), " ".join(rng.choices(["river", "hill", "the", "license"], weights=[9, 9, 9, 1], k=rng.choice([0, 3, 60, 400])))]
        text = rng.choice([" ", "\n"]).join(parts)
        own = licenses.words(text)
        hits = []
        for k, t in enumerate(licenses.templates()):
            for d, version, i, j in licenses.stretches(t.words, own, licenses.TOLERANCE * len(t.words)):
                hits.append((d, len(t.words) - d, k, version, i, j))
        want = [(licenses.templates()[k].license, version, d, i) for d, _, k, version, i, _ in licenses._apart(hits)]
        assert [(r[0], r[1], r[3], r[7]) for r in licenses.scan_text(text) if r[5]] == want


def test_windows_hold_every_stretch_near_a_gate():
    rng = random.Random(4)
    for _ in range(40):
        pair = re.sub(r"\(\?i\)|\\", "", licenses.gate()).split("|")[rng.randrange(10)].split("[W_]+")
        text = "\n".join(rng.choice(["word", "\n".join(pair), "x"] if rng.random() < 0.02 else ["word", "x"]) for _ in range(2_000))
        found, regions = licenses.windows(text)
        ranges = [w for r in regions for w in r]
        span = licenses._span()
        for g, m in enumerate(found):
            if m.group() == pair[0] and g + 1 < len(found) and found[g + 1].group() == pair[1]:
                for i in range(max(0, g + 1 - span + 1), g + 1):
                    assert any(lo <= i and min(i + span, len(found)) <= hi for lo, hi in ranges)


def test_a_licence_is_suppressed_only_where_another_overlaps():
    alike = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    assert [r[0] for r in licenses.scan_text(alike)] == ["CC-BY-SA"]
    apart = alike + "\nThis work is licensed under a Creative Commons Attribution 3.0 Worldwide License."  # each CC-BY match differs in a word
    assert [r[:2] + (r[3], r[6]) for r in licenses.scan_text(apart)] == [("CC-BY-SA", "4.0", 0, 0), ("CC-BY", "3.0", 1, 1)]


def test_wrapped_header_and_small_changes():
    header = next(t for n, t in licenses.TEMPLATES if n == "Apache" and len(t) > 200).replace("<v>", "2.0").split(" ")
    lines = [" ".join(header[i : i + 7]) for i in range(0, len(header), 7)]
    (got,) = licenses.scan_text("prose\n\n" + "\n".join("# " + x for x in lines).replace("file", "work"))
    assert got[:2] == ("Apache", "2.0") and 1 <= got[3] <= 6 and got[5:7] == (True, 2)


def test_other_licences_and_prose_are_not_confirmed():
    assert not any(r[5] for r in licenses.scan_text("Licensed under the Wibble Public License."))
    assert not any(r[5] for r in licenses.scan_text("the driver lost his licence and asked permission to walk"))
    assert [r[0] for r in licenses.scan_text("Licensed under CC BY-NC 4.0.") if r[5]] == ["CC-BY-NC"]
    assert licenses.scan_text("© copyright") == [] or not licenses.scan_text("© copyright")[0][5]


def test_scan(spark):
    rows = [
        (1, "prose here\nReleased under the MIT License.\nmore prose", 0),
        (2, None, 0), (3, "", 0), (4, "nothing to see", 0),
        (5, "Licensed under CC BY-NC 4.0.\n\nThis work is licensed under the GNU General Public License, version 3.", 0),
        (6, "word " * 50_000 + "\nLicensed under the Apache License, Version 2.0.", 0),
        (1, "prose here\nReleased under the MIT License.\nmore prose", 0), (None, "Released under the MIT License.", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int").repartition(3)
    got = sorted((r.doc_id or 0, r.line, r.license, r.version or "", r.differing_words) for r in licenses.scan(docs).collect() if r.confirmed)
    assert got == [(0, 0, "MIT", "", 0), (1, 1, "MIT", "", 0), (1, 1, "MIT", "", 0), (5, 0, "CC-BY-NC", "4.0", 0), (5, 2, "GPL", "3", 0), (6, 1, "Apache", "2.0", 0)]
    assert licenses.scan(docs.limit(0)).count() == 0


def changed(rng, words, times):
    """The words after so many words replaced, left out or put in, at places taken by chance."""
    out = list(words)
    for _ in range(times):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        out[i : i + (kind != 2)] = [] if kind == 1 and len(out) > 1 else [f"zq{rng.randrange(99)}"]
    return out


def test_gate_loses_no_match():
    """Each template with each single word replaced, and with as many changes as are allowed at once, has a pair of the gate."""
    rng = random.Random(1)
    pattern = re.compile(licenses.gate())
    tested = 0
    for t in licenses.templates():
        words = ["2.0" if w == "<v>" else w for w in t.words]
        allowed = int(licenses.TOLERANCE * len(words))
        versions = [[w if j != i else "zqx" for j, w in enumerate(words)] for i in range(len(words))] if allowed else [words]
        versions += [changed(rng, words, allowed) for _ in range(200)]
        for v in versions:
            text = rng.choice([" ", " * ", "\n# "]).join(w.upper() if rng.random() < 0.2 else w for w in v)
            assert pattern.search(text), text
            tested += 1
    assert tested > 5000


def test_changed_notices_are_confirmed():
    """Every notice of ten or more words with any one word replaced is found, whichever word it is."""
    for t in licenses.templates():
        words = ["2.0" if w == "<v>" else w for w in t.words]
        if len(words) < 10 or len(words) > 40:
            continue
        for i in range(len(words)):
            got = licenses.scan_text("lorem ipsum " * 20 + " ".join(w if j != i else "zqx" for j, w in enumerate(words)) + " dolor sit" * 20)
            assert any(r[0] == t.license and r[5] for r in got), (t.license, i)
