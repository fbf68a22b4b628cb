import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from chainlake.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    """The contract's patterns as they are written."""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(float(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_terms(texts):
    """Revealing terms by counting every window directly."""
    total, n_t, n_e, n_te, seen = 0, Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        spans = plain_spans(text)
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(lower(text))]
        total += len(words)
        n_t.update(w for *_, w in words)
        free = [w for w in words if not any(w[0] < e and s < w[1] for _, s, e in spans)]
        for kind, s, e in spans:
            value = text[s:e]
            entity = f"{pii.KINDS[kind]}:{lower(value) if kind < 2 else digits(value)}"
            n_e[entity] += 1
            near = [w for a, _, w in free if a < s][-pii.WINDOW:] + [w for a, _, w in free if a >= e][:pii.WINDOW]
            for w in set(near):
                n_te[w, entity] += 1
                seen[w, entity].add(tuple(near))
    best = {}
    for (t, e), n in n_te.items():
        if len(seen[t, e]) >= pii.SUPPORT and n_e[e] < total:
            p = n_e[e] / total
            d = math.log(min(1, n / n_t[t]) / p) / -math.log(p)
            if d >= pii.GENERALISE and (t not in best or (-d, e) < best[t]):
                best[t] = (-d, e)
    return {t: (e, -d, "remove" if -d >= pii.REMOVE else "generalise") for t, (d, e) in best.items()}


def brute_spans(texts):
    terms = brute_terms(texts)
    out = []
    for text in texts:
        base = plain_spans(text)
        spans = [(pii.KINDS[k], s, e, "remove") for k, s, e in base]
        for m in WORD.finditer(lower(text)):
            word = m.group()
            if word in terms and not any(m.start() < e and s < m.end() for _, s, e in base):
                spans.append((pii.TERM, *m.span(), terms[word][2]))
        out.append(spans)
    return out


CORNERS = ["a@b.c", "a@b", "@b.c", "a@b.c.d@e.f", "a..b%+-@x-y.z.", "a@b.c@d.e", "é@b.c", "aé.x@b.cé", "1.2.3.4", "256.1.1.1",
           "1.2.3.4.5", "1.2.3.4.5.6.7.8", "01.002.0003.00004", "1.2.3", "9" * 5000 + ".1.1.1", "4111 1111 1111 1111",
           "4111-1111-1111-1111", "4111 1111 1111 1112", "4111  1111 1111 1111", "+4111111111111111", "+1 (249) 555-1332",
           "+1(2", "+12345678", "+1234567", "++12 345 678", "+1234567890123456", "+1 2 3 4 5 6 7 8 ()", "", "+", "@", "x@y.z+12345678"]


def test_patterns_equal_their_definition():
    draw = random.Random(2)
    for text in CORNERS + [" ".join(CORNERS)]:
        assert pii.base_spans(text) == plain_spans(text), text
    for _ in range(20000):
        text = "".join(draw.choice("aZ0149..@@+- ()é%\n") for _ in range(draw.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("part", ["a", "1", "1.", "1 ", "+1 ", "a@", "@", "a@b", "a.", "-", "+"])
def test_patterns_take_linear_time(part):
    start = time.perf_counter()
    pii.base_spans(part * 200_000)
    assert time.perf_counter() - start < 5


def corpus():
    """Entities with a word of their own ('Quorl', 'Vexo'), a common word and chance neighbours."""
    draw = random.Random(9)
    common = [f"w{k}" for k in range(40)]

    def some(n):
        return " ".join(draw.choice(common) for _ in range(n))
    texts = [f"{some(30)}." for _ in range(200)]
    texts += [f"{some(9)} Quorl {some(2)} j.doe@mail.example.com, {some(9)}" for _ in range(6)]
    texts += [f"{some(12)} vexo {some(1)} +1 (249) 555-1332 {some(12)}" for _ in range(4)] + [f"{some(5)} VEXO {some(5)}" for _ in range(2)]
    texts += ["copies onlyhere of one text x@y.example.com " + some(3)] * 50
    texts += [f"{some(3)} quorl {some(3)}", "", "quorl@quorl.example.com", "é ñ Quorl ü 10.0.0.1, 4111 1111 1111 1111"]
    return texts


def test_terms_and_spans_equal_brute_force(spark, docs_frame):
    texts = corpus()
    want = brute_terms(texts)
    assert set(want) >= {"quorl", "vexo"} and "onlyhere" not in want and not any(t.startswith("w") for t in want)
    docs = docs_frame(list(enumerate(texts)))
    got = {r.term: (r.entity, round(r.disclosure, 9), r.action) for r in pii.revealing_terms(docs).collect()}
    assert got == {t: (e, round(d, 9), a) for t, (e, d, a) in want.items()}
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(docs).collect()}
    assert found == dict(enumerate(brute_spans(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for k, (text, spans) in enumerate(zip(texts, brute_spans(texts))):
        assert clean[k] == pii.sanitised(text, spans)
        assert not any(text[s:e] in clean[k] for _, s, e, _ in spans)
        assert not pii.base_spans(clean[k])


def test_sanitised_classes():
    assert pii.sanitised("a x@y.zz 123 b", [("term", 0, 1, "generalise"), ("email", 2, 8, "remove"), ("term", 9, 12, "generalise"),
                                            ("term", 13, 14, "remove")]) == "[WORD] [EMAIL] [NUMBER] [REMOVED]"
    assert pii.sanitised("+4111111111111111", [("card", 1, 17, "remove"), ("phone", 0, 17, "remove")]) == "[PHONE]"


def test_edge_rows(spark, docs_frame):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (3, "a@b.cc"), (3, "a@b.cc"), (4, "no data")]
    got = sorted((str(r.doc_id), [tuple(s)[:3] for s in r.spans]) for r in pii.find_personal_data(docs_frame(rows)).collect())
    mail = [("email", 0, 6)]
    assert got == [("1", []), ("2", []), ("3", mail), ("3", mail), ("4", []), ("None", mail)]
    empty = spark.createDataFrame([], "doc_id long, text string, spans string")
    assert pii.find_personal_data(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_query_equals_brute_force(spark, small_dir):
    docs = pq.read_table(f"{small_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = []
    for d, spans in zip(docs, brute_spans([d["text"] or "" for d in docs])):
        text = [":".join(map(str, s[:3])) for s in spans]
        kinds = Counter(s[0] for s in spans)
        base = ",".join(t for t, s in zip(text, spans) if s[0] != pii.TERM)
        want.append((d["doc_id"], *(kinds[k] for k in (*pii.KINDS, pii.TERM)), hashlib.sha256(base.encode()).hexdigest(), ",".join(text)))
    assert sorted(tuple(r) for r in queries.op11_pii(spark, small_dir).collect()) == sorted(want)
    assert all(sum(r[k] for r in want) for k in (1, 2, 3, 4))
