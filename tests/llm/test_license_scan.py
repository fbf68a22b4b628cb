import random

from chainlake.llm import license_scan as s
from chainlake.llm.grams import Words


def words(text):
    w = Words((text or "").encode())
    return [w.gram(i, 1).decode() for i in range(len(w))]


def brute_base(text):
    own, places, labels = words(text), [], set()
    for t in s.PHRASES:
        p = t.text.split()
        at = [i for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p]
        places += at
        labels |= {t.label} if at else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_columns_on_all_documents(spark, small_dir):
    from chainlake.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = QUERIES["op2_license_scan"](spark, small_dir).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        assert base(r) == brute_base(docs[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_hard_cases(spark, docs_frame):
    long_notice = s.NOTICES[1].text.upper().replace(" ", ",\n ")
    gap = long_notice.replace("HEREBY", "hereby really").replace("ANY ", "")
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "MIT"), (3, "mit-license MIT\tLicense, general public license mit license"),
            (4, "mit mit license license"), (5, "x " * 70_000 + "mit license"), (None, "The Apache License"), (6, "dup mit license"),
            (6, "dup mit license"), (7, long_notice), (8, "pre " * 9 + gap + " post"), (9, " ".join(long_notice.split()[:9])),
            (10, " ".join(rng.sample(long_notice.split(), len(long_notice.split())))), (11, "Licensed under CC BY-NC 4.0."),
            (12, "mit license " * 5000), (13, "general public general public license public license")]
    got = s.scan_licenses(docs_frame(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        assert base(by[i]) == brute_base(t), i
    assert by[7].labels == by[8].labels == "mit" and by[8].score < by[7].score == 1
    assert by[9].labels == by[10].labels == "" and 0 < by[9].score < 0.8
    assert by[11].labels == "cc-by-nc" and by[11].base_labels == ""
    assert by[0].score == 0 and by[12].n_base == 5000
    assert (by[8].spans[0].first, by[8].spans[0].label) == (9, "mit")
    assert s.scan_licenses(docs_frame(rows).limit(0)).count() == 0
    assert s.scan_licenses(docs_frame(rows[:4]), templates=[]).where("n_base > 0").count() == 0


def brute_method(text, templates):
    """Labels and score by trying every template at every place."""
    own, labels, best = words(text), set(), 0.0
    for t in templates:
        want = words(t.text)
        k = min(s.K_PHRASE if t.phrase else s.K_NOTICE, len(want))
        lines = {}
        for place in range(len(own) - k + 1):
            for at in range(len(want) - k + 1):
                if own[place:place + k] == want[at:at + k]:
                    lines.setdefault(place - at, []).append((place, at))
        groups = []
        for d in sorted(lines):
            if not t.phrase and groups and d - groups[-1][0] <= s.MERGE:
                groups[-1] = (d, groups[-1][1] + lines[d])
            else:
                groups.append((d, lines[d]))
        for _, hits in groups:
            share = len({at for _, at in hits}) / (len(want) - k + 1)
            length = max(p for p, _ in hits) + k - min(p for p, _ in hits)
            found = share == 1 if t.phrase else share >= s.COVERAGE and length <= s.STRETCH * len(want)
            best = max(best, share if found or not t.phrase else 0.0)
            labels |= {t.label} if found else set()
    return ",".join(sorted(labels)), best


def test_labels_and_score_equal_brute_force(spark, docs_frame):
    templates = s.PHRASES + s.NOTICES + s.TAGS
    rng = random.Random(4)
    texts = []
    for t in templates:
        own = t.text.split()
        texts.append(t.text)
        for _ in range(2):  # words lost, added and swapped, and two notices in a row
            changed = [w for w in own for _ in range(rng.choice([1, 1, 1, 1, 1, 1, 1, 2, 0]))]
            texts.append(" ".join(["so", *changed, *rng.choice(templates).text.split(), "end", *rng.sample(own, len(own))]))
    got = {r.doc_id: (r.labels, r.score) for r in s.scan_licenses(docs_frame(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        labels, score = brute_method(text, templates)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-12, text


def test_tags_and_named_licences(spark, docs_frame):
    want = {"// SPDX-License-Identifier: GPL-3.0-only": "gpl", "# SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
            "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa", "SPDX-License-Identifier: CC-BY-4.0": "cc-by",
            "SPDX-License-Identifier: MIT": "mit", "BSD 3-Clause License": "bsd", "the GNU Lesser General Public License": "gpl,lgpl",
            "the GNU Affero General Public License": "agpl,gpl", "SPDX-License-Identifier: none": "", "MIT, BSD, ISC": ""}
    got = {r.doc_id: r.labels for r in s.scan_licenses(docs_frame(list(enumerate(want)))).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    for t in s.NOTICES + s.TAGS:  # each wording gives its own label
        assert t.label in brute_method(t.text, s.PHRASES + s.NOTICES + s.TAGS)[0].split(",")
