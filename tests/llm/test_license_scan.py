import re
from collections import Counter

import pytest

from foliant.llm.license_scan import TEMPLATES, THRESHOLD, scan_licenses


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w):
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter([(x,) for x in w])


def found(spark, texts, templates=TEMPLATES):
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id bigint, text string, dice double")
    return sorted((r.doc_id, r.license_id, round(r.dice, 6), r.first_word, r.n_words, r.passage) for r in scan_licenses(df, templates).collect())


def test_every_template_is_found(spark):
    texts = [f"Some words before it.\n{t.upper() if k % 2 else t}\nand after the text." for k, (_, t, _) in enumerate(TEMPLATES)]
    got = found(spark, texts)
    for k, (name, t, _) in enumerate(TEMPLATES):
        hits = [h for h in got if h[0] == k]
        assert (name, 1.0, 4, len(words(t))) in [h[1:5] for h in hits]


def test_best_windows_equal_brute_force(spark):
    templates = (("A", "alpha beta gamma delta epsilon"), ("B", "alpha beta gamma zeta eta theta"))
    texts = ["x alpha beta gamma delta epsilon y", "alpha beta GAMMA, delta epsilon", "alpha beta gamma", "alpha beta q gamma delta epsilon", "alpha beta gamma zeta eta theta alpha beta gamma delta epsilon"]
    got = found(spark, texts, templates)
    for k, t in enumerate(texts):
        w, best = words(t), {}
        for name, template in templates:
            m = bag(words(template))
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    x = bag(w[i:j])
                    dice = 2 * sum((x & m).values()) / (x.total() + m.total())
                    if dice >= THRESHOLD:
                        best[name] = max(best.get(name, 0), round(dice, 6))
        assert {h[1]: h[2] for h in got if h[0] == k} == best


def test_edge_cases(spark):
    line = "Released under the MIT License."
    got = found(spark, [None, "", "MIT", line, line + "\n" + line, "word " * 30_000 + line, "Released under the MIT"])
    assert [(g[0], g[3]) for g in got] == [(3, 0), (4, 0), (4, 5), (5, 30_000), (6, 0)]
    assert found(spark, []) == []


@pytest.mark.parametrize("name", ["MIT", "GPL-3.0"])
def test_edited_notice(spark, name):
    text = next(t for n, t, _ in reversed(TEMPLATES) if n == name and len(words(t)) > 8)
    got = found(spark, [text.replace(words(text)[5], "changed", 1)])
    assert got and got[0][1] == name


def test_versions_are_told_apart(spark):
    later = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = [later.format(2), later.format(3), later.format(7), "This work is licensed under the GNU General Public License, version 1.", "This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY 3.0.", "Licensed under CC BY-SA 2.5."]
    got = {k: [h[1] for h in found(spark, texts) if h[0] == k] for k in range(len(texts))}
    assert got == {0: ["GPL-2.0-or-later"], 1: ["GPL-3.0-or-later"], 2: [], 3: ["GPL-1.0"], 4: [], 5: ["CC-BY-3.0"], 6: ["CC-BY-SA-2.5"]}


def test_bsd_by_the_third_clause(spark):
    two, three = (next(t for n, t, _ in TEMPLATES if n == name) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    got = found(spark, [f"Copyright (c) 2020, A. Author\n{two}", f"Copyright (c) 2020, A. Author\n{three}"])
    assert [h[:3] for h in got] == [(0, "BSD-2-Clause", 1.0), (1, "BSD-3-Clause", 1.0)]


def test_many_copies_in_one_text(spark):
    import time

    import numpy as np

    from foliant.llm.license_scan import Matcher, bigrams
    from foliant.llm.license_scan import _LOWER, _SEP
    from foliant.llm.tokens import words as hashes

    text = max((t for n, t, _ in TEMPLATES if n == "MIT"), key=len)
    matcher, times = Matcher(), []
    for copies in (20, 200):
        data = np.frombuffer(f"{text}\n".encode() * copies, np.uint8)
        x = bigrams(hashes(data, np.array([0, len(data)]), 0, 1, _SEP, _LOWER).hash)
        began = time.process_time()
        got = matcher.best(*matcher.hits(x))
        times.append(time.process_time() - began)
        assert [matcher.names[t] for _, t, _, _ in got] == ["MIT"] * copies
    assert times[1] < 30 * times[0] + 1


def test_a_table_of_templates(spark, tmp_path):
    from foliant.llm.license_texts import read_templates

    (tmp_path / "Own-1.0.txt").write_text("You may do with this text as you please on any day of the year but not on Sundays.")
    table = read_templates(spark, str(tmp_path))
    got = found(spark, ["x You may do with this text as you please on any day of the year, but not on sundays y", None], table)
    assert [h[:3] for h in got] == [(0, "Own-1.0", 1.0)]
