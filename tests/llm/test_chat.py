"""Chat formatting: layouts by fingerprint, reading back, digests against plain code, nulls, ties, long texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from statloom.llm import chat_formatting as cf
from tests.helpers import rows_of

ROWS = "conv_id long, turn long, role string, text string"
#: One record of every layout: (fields as JSON, its name, its turns).
RECORDS = [
    ('{"role":"user","text":"hi"}', "turn", [("user", "hi")]),
    ('{"text":"no role"}', "turn", [("", "no role")]),
    ('{"prompt":"p","completion":"c"}', "completion", [("user", "p"), ("assistant", "c")]),
    ('{"system":"s","prompt":"p","response":"c"}', "response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ('{"instruction":"i","input":"x","output":"o"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ('{"instruction":"i","input":"","output":"o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"instruction":"i","output":"o","system":"s"}', "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ('{"question":"q","answer":"a","context":"c"}', "question", [("system", "c"), ("user", "q"), ("assistant", "a")]),
    ('{"request":{"text":"q","lang":"en"},"reply":{"text":"a"}}', "nested", [("user", "q"), ("assistant", "a")]),
    ('{"messages":[{"role":"system","content":"s"},{"role":"bot","content":"c"},{"role":"user"}]}', "messages", [("system", "s"), ("assistant", "c"), ("user", "")]),
    ('{"conversations":[{"from":"human","value":"h"},{"from":"GPT","value":"g"}]}', "dialogue", [("user", "h"), ("assistant", "g")]),
    ('{"prompt":"p","messages":[{"role":"user","content":"c"}]}', None, []),
    ('{"prompt":"p"}', None, []),
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("records") / "all.json"
    at.write_text("\n".join('{"conv_id":%d,%s' % (i, r[0][1:]) for i, r in enumerate(RECORDS)))
    return spark.read.json(str(at)).withColumn("turn", F.lit(0)).withColumn("layout", F.lit("own")).withColumn("a.b", F.lit(1)).cache()


def test_fingerprints_choose_the_layout(records):
    found = {}
    for r in cf.canonical_turns(records).orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], (r["layout"], []))[1].append((r["role"], r["text"]))
    assert found == {i: (name, turns) for i, (_, name, turns) in enumerate(RECORDS) if name}
    lost = cf.unmapped(records)
    assert sorted(r["conv_id"] for r in lost.collect()) == [i for i, r in enumerate(RECORDS) if r[1] is None]
    assert lost.columns == [*records.columns, "fingerprint"]


def test_layouts_have_distinct_fingerprints_as_spark_hashes_them(spark):
    seen = [f for layout in cf.LAYOUTS for f in layout.fingerprints()]
    assert len(seen) == len(set(seen))
    paths = ["prompt", "a[].b", "é"]
    assert spark.range(1).select(F.xxhash64(F.lit("\n".join(sorted(paths))))).first()[0] == cf.fingerprint_of(paths)


def test_a_table_without_any_layout(spark):
    df = spark.createDataFrame([(1, 0, "x")], "conv_id long, turn int, body string")
    assert cf.canonical_turns(df).count() == 0 and cf.unmapped(df).count() == 1


def said() -> list[tuple]:
    rng = random.Random(9)
    bits = ["<", "|", "\\", "<|", "<\\|", "im_start", "|>", cf.START, cf.END, "\n", "\r\n", "assistant", " ", "é", "👍", "$1", "\x00", "漢字"]
    messy = lambda n: "".join(rng.choice(bits) for _ in range(n))
    roles = ["user", "assistant", "system", None, "", "a\nb", "\\n", "\\", "x\\\n<|y", cf.END, "\r\n", "Assistant"]
    rows = [(rng.randrange(12), rng.choice([0, 1, 2, 3, None]), rng.choice(roles), rng.choice([None, "", messy(3), messy(40)])) for _ in range(600)]
    rows += [rows[0], rows[0], (None, 0, "user", "q"), (None, 1, "assistant", "a"), (50, 0, "assistant", messy(60_000)), (51, None, None, None)]
    return rows


def plain(rows: list[tuple]) -> list[dict]:
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        loss = [t[3] for t in turns if t[2] == "assistant"]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), "loss_chars": len("".join(loss)), "loss_sha256": sha("".join(loss))})
    return out


def test_texts_come_back_as_they_were(spark):
    rows = said()
    df = spark.createDataFrame(rows, ROWS).withColumn("formatted", F.lit("own")).withColumn("place", F.lit(3))
    trap = [(-1, 0, "user", cf.TRAP), (-1, 1, "assistant", cf.TRAP)]
    found = cf.conversation_digests(df)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert rows_of(names, [[r[n] for n in names] for r in found.collect()]) == rows_of(names, [[r[n] for n in names] for r in plain(rows + trap)])


def test_every_row_of_the_query_finds_its_layout(spark):
    records = cf.records_of(spark.createDataFrame(said(), ROWS))
    assert cf.unmapped(records).count() == 0
    found = {(r["layout"], r["role"]) for r in cf.canonical_turns(records).select("layout", "role").distinct().collect()}
    assert {("messages", "system"), ("dialogue", "assistant"), ("turn", "user"), ("turn", ""), ("messages", "user")} <= found
    assert {layout for layout, role in found if role == "assistant"} == {"dialogue", "messages"}  # the latter is the trap


def test_marks_occur_only_at_the_ends_of_turns(spark):
    formatted = cf.formatted_turns(cf.canonical_turns(spark.createDataFrame(said(), ROWS))).collect()
    for r in formatted:
        text = r["formatted"]
        assert text.startswith(cf.START) and text.endswith(cf.END + "\n") and text.count("<|") == 2
    length = {}
    for r in formatted:
        length[r["conv_id"]] = length.get(r["conv_id"], 0) + len(r["formatted"])
    found = cf.conversation_digests(spark.createDataFrame(said(), ROWS)).where("conv_id >= 0 or conv_id is null").collect()
    assert {r["conv_id"]: r["formatted_chars"] for r in found} == length


def test_no_conversations_leave_the_trap(spark):
    found = cf.conversation_digests(spark.createDataFrame([], ROWS)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in found] == [(-1, 2, len(cf.TRAP))]


def test_a_conversation_longer_than_a_batch(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(25_000)]
    found = cf.conversation_digests(spark.createDataFrame(rows, ROWS)).where("conv_id = 1").first()
    expected = plain(rows)[0]
    assert all(found[k] == v for k, v in expected.items())
