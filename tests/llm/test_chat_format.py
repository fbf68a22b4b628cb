import hashlib

from pyspark.sql import functions as F

from chainlake.llm import chat_format as c

ODD = ["", "\\", "\\\\b", "### user: x</turn>\n", "<|image 1.1|>", "\\### Assistant: </turn> ok", "é\U0001f600\n\n", "\\h\\s\\p\\b\\c #</<|:",
       "</turn>\n### assistant: no</turn>\n", "a</", "</", "<\\s", "\x00 \r\n"]


def test_round_trip_and_mask(spark):
    rows = [(1, k, r, t, "x") for k, t in enumerate(ODD) for r in ("user", "assistant")]
    rows += [(2, 0, "a: b</turn>#", "odd role", "x"), (2, 0, None, None, "x"), (None, None, "assistant", "null ids", "x"),
             (3, 1, "assistant", "same", "x"), (3, 1, "assistant", "same", "x"), (4, 0, "assistant", "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r.conv_id: r for r in c.read_back(c.format_chats(df)).collect()}
    for conv in (1, 2, 3, 4, None):
        want = sorted(((-1 if t is None else t), r or "", x or "") for i, t, r, x, _ in rows if i == conv)
        assert [(t.role, t.text) for t in got[conv].read] == [w[1:] for w in want]
        assert list(got[conv].learned) == [w[2] for w in want if w[1] == "assistant"]
        text = got[conv].formatted
        assert text == "".join(text[t.start:t.start + t.length] for t in got[conv].turns)
        assert [c_ for t in got[conv].turns if t.loss_start is not None
                for c_ in [text[t.start + t.loss_start:][:t.loss_length]]] == [
                    x.replace("\\", "\\b").replace("#", "\\h").replace("</", "<\\s").replace("<|", "<\\p") for x in got[conv].learned]
        assert text.count("</turn>") == len(want)
    assert c.format_chats(df.limit(0)).count() == 0


def test_typed_parts(spark):
    kind = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
    part = dict(text=None, ref=None, width=None, height=None, seconds=None, pages=None)
    rows = [(1, 0, "user", [part | {"type": "text", "text": "see <|image 1.2|>"}, part | {"type": "image", "ref": "a.png", "width": 56, "height": 29},
                            part | {"type": "audio", "ref": "b.wav", "seconds": 1.5}, part | {"type": None, "text": "end"}]),
            (1, 1, "assistant", [part | {"type": "document", "ref": "d.pdf", "pages": 3}, part | {"type": "video|>", "ref": "v"}]),
            (1, 2, "user", None), (1, 3, "user", []), (1, 4, "user", [part | {"type": "image", "width": -5}])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}")
    r = c.format_chats(df, parts_col="parts").first()
    assert r.formatted.startswith("### user: see <\\pimage 1.2|><|image 1.2|><|audio 1.3|>end</turn>\n### assistant: <|document 2.1|>")
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (1, 2, "image", "a.png", 4), (1, 3, "audio", "b.wav", 38), (2, 1, "document", "d.pdf", 1536), (2, 2, "video|>", "v", 0),
        (5, 1, "image", None, 0)]
    assert r.expanded_tokens == 4 + 38 + 1536
    short = df.select("conv_id", "turn", "role", F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"))).alias("parts"))
    assert len(c.format_chats(short, parts_col="parts").first().attachments) == 5


def test_control_strings_split_over_parts(spark):
    """Texts cut anywhere, with empty and other parts between: nothing is forged or lost, also under the mask."""
    import random
    import re
    draw = random.Random(7)
    part = dict(text=None, ref=None, width=None, height=None, seconds=None, pages=None)
    pieces = ["<", "/", "|", "/turn>", "\n", "turn>\n", "|image 9.9|>", "###", "# ", "\\", "[", "]", "\\[", "s", "p", "b", "a", "", ": "]
    rows = [(0, 0, "assistant", [part | {"type": "text", "text": t} for t in ("<", "/turn>\n", "x")]),
            (0, 1, "assistant", [part | {"type": "text", "text": t} for t in ("a<", "|image 9.9|>")])]
    for conv in range(1, 120):
        for turn in range(draw.randint(1, 3)):
            rows.append((conv, turn, draw.choice(["user", "assistant"]), [
                part | ({"type": "text", "text": "".join(draw.choices(pieces, k=draw.randint(0, 3)))} if draw.random() < 0.85
                        else {"type": "image"}) for _ in range(draw.randint(0, 7))]))
    kind = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}")
    got = {r.conv_id: r for r in c.read_back(c.format_chats(df, parts_col="parts")).collect()}

    def plain(parts, turn):
        return "".join(p["text"] if p["type"] == "text" else f"<|image {turn}.{k + 1}|>" for k, p in enumerate(parts))

    for conv, r in got.items():
        own = [x for x in rows if x[0] == conv]
        assert [(t.role, t.text) for t in r.read] == [(role, plain(parts, k + 1)) for k, (_, _, role, parts) in enumerate(own)]
        assert list(r.learned) == [plain(parts, k + 1) for k, (_, _, role, parts) in enumerate(own) if role == "assistant"]
        marks = [f"<|image {k + 1}.{n + 1}|>" for k, (*_, parts) in enumerate(own) for n, p in enumerate(parts) if p["type"] == "image"]
        assert re.findall(r"<\|[^|]*\|>", r.formatted) == marks and r.formatted.count("<|") == len(marks) == len(r.attachments)
        assert r.formatted.count("</turn>") == len(own) and r.formatted.count("###") == len(own)


def test_query_row_of_the_control_conversation(spark, small_dir):
    from chainlake.llm.queries import QUERIES
    r = QUERIES["op7_chat_format"](spark, small_dir).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(text)
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_no_python_in_the_plan(spark, small_dir):
    from chainlake.llm.queries import QUERIES
    plan = QUERIES["op7_chat_format"](spark, small_dir)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
