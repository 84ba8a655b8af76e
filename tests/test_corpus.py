"""Alignment, templates, registry, readers, sinks and caches on hand-made rows."""

import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusflow.functions import render as R
from corpusflow.functions import templates as Tm
from corpusflow.functions import tokenizers as Tk
from corpusflow.operators import align as A
from corpusflow.operators.ordering import id_chunk
from corpusflow.plans.catalog import CHAT
from corpusflow.sources import cache, readers, registry, sinks
from corpusflow.sources.registry import DatasetSpec

TURNS = "conv_id long, turn long, role string, text string"


def chat_rows():
    rows = []
    for c in range(12):
        names = (["system"] if c % 4 == 0 else []) + ["user", "assistant"] * (c % 5) + (["user"] if c % 3 == 0 else [])
        rows += [(c, i, r, f"{c}.{i}") for i, r in enumerate(names)]
    return rows


def python_align(rows):
    out = []
    for c in sorted({r[0] for r in rows}):
        msgs = [(r[2], r[3]) for r in sorted(rows) if r[0] == c]
        system = msgs.pop(0)[1] if msgs and msgs[0][0] == "system" else ""
        msgs = msgs[: len(msgs) // 2 * 2]
        out += [(c, i, "prompt" if i < len(msgs) - 1 else "response", r, t, system) for i, (r, t) in enumerate(msgs)]
    return sorted(out)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_turn_rows_align_like_records(spark, rows):
    turns = spark.createDataFrame(chat_rows(), TURNS)
    out = A.align_conversations(turns, "conv_id", "turn", "role", "text", CHAT, id_chunk("turn", rows))
    assert sorted(tuple(r) for r in out.select("conv_id", "idx", "part", "role", "content", "system").collect()) == python_align(chat_rows())


def test_turn_rows_without_system_tag_keep_their_conversation(spark):
    spec = registry.with_tags(DatasetSpec(name="x", formatting="sharegpt"), {"user_tag": "user", "assistant_tag": "assistant"})
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(6)]
    for chunk in (1, 2, 100):
        out = A.align_conversations(spark.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text", spec, id_chunk("turn", chunk))
        assert [r["content"] for r in out.orderBy("idx").collect()] == [f"t{i}" for i in range(6)]


def test_turn_rows_carry_system_tools_and_validity(spark):
    spec = DatasetSpec(name="x", formatting="sharegpt", user_tag="user", assistant_tag="assistant", system="sys", tools="tools")
    rows = [(1, 0, "user", "a", "S", "T"), (1, 1, "assistant", "b", "S", "T"), (2, 0, "user", "a", None, None), (2, 1, None, "b", None, None)]
    turns = spark.createDataFrame(rows, TURNS + ", sys string, tools string")
    args = ("conv_id", "turn", "role", "text", spec, id_chunk("turn", 1))
    out = A.align_conversations(turns, *args, mode="quarantine").orderBy("conv_id", "idx").collect()
    assert [(r["conv_id"], r["system"], r["tools"], r["valid"]) for r in out] == [(1, "S", "T", True)] * 2 + [(2, "", "", False)] * 2
    assert {r["conv_id"] for r in A.align_conversations(turns, *args, mode="drop").collect()} == {1}
    with pytest.raises(PySparkException, match="invalid role tag"):
        A.align_conversations(turns, *args).collect()


BAD = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "system", "s"), (3, 0, "user", "q"), (3, 1, "assistant", "r")]


def test_role_order_modes(spark):
    chats = A.assemble_turns(spark.createDataFrame(BAD, TURNS), "conv_id", "turn", "role", "text")
    assert [r["conv_id"] for r in A.align(chats, CHAT, ["conv_id"], "drop").collect()] == [3]
    marked = {r["conv_id"]: r["valid"] for r in A.align(chats, CHAT, ["conv_id"], "quarantine").collect()}
    assert marked == {1: False, 3: True}
    with pytest.raises(PySparkException, match="invalid role tag"):
        A.align(chats, CHAT, ["conv_id"]).collect()
    with pytest.raises(PySparkException, match="invalid role tag"):
        A.align_conversations(spark.createDataFrame(BAD, TURNS), "conv_id", "turn", "role", "text", CHAT, id_chunk("turn", 1)).collect()
    dropped = A.align_conversations(spark.createDataFrame(BAD, TURNS), "conv_id", "turn", "role", "text", CHAT, id_chunk("turn", 1), "drop")
    assert {r["conv_id"] for r in dropped.collect()} == {3}


def test_alpaca_skips_empty_parts(spark):
    df = spark.createDataFrame([(1, "p", "", "a"), (2, "", "q", None), (3, None, None, "")], "id long, instruction string, input string, output string")
    got = {r["id"]: (r["prompt"][-1]["content"], [m["content"] for m in r["response"]]) for r in A.align(df, DatasetSpec(name="x"), ["id"]).collect()}
    assert got == {1: ("p", ["a"]), 2: ("q", []), 3: ("", [""])}


def test_empty_message_list_is_dropped(spark):
    df = spark.createDataFrame([(1, [])], "id long, conversations array<struct<from:string,value:string>>")
    assert A.align(df, CHAT, ["id"]).count() == 0


def test_chosen_and_rejected_columns(spark):
    spec = registry.with_columns(DatasetSpec(name="x", ranking=True), {"prompt": "p", "chosen": "c", "rejected": "r"})
    df = spark.createDataFrame([(1, "p", "good", "bad")], "id long, p string, c string, r string")
    assert [m["content"] for m in A.align(df, spec, ["id"]).first()["response"]] == ["good", "bad"]


def test_nonempty_text(spark):
    texts = ["", " \t\n", "  　", "\x1c\x0b", "a", " ​ "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    assert sorted(r["id"] for r in A.nonempty_text(df, "t").collect()) == [i for i, t in enumerate(texts) if t.strip()]


# Templates


def render(spark, template, msgs, system="", tools=""):
    df = spark.createDataFrame([(msgs, system, tools)], "m array<struct<role:string,content:string>>, s string, t string")
    return df.select(R.Renderer(Tm.get_template(template), "<s>", "</s>").text(F.col("m"), F.col("s"), F.col("t")).alias("x")).first()["x"]


CHAT_MSGS = [("user", "hi"), ("assistant", "yo"), ("user", "bye"), ("assistant", "ok")]


@pytest.mark.parametrize(
    "template,system,expected",
    [
        ("vanilla", "", ["hi", "yo</s>", "bye", "ok</s>"]),
        ("mistral", "", ["<s>[INST] hi [/INST]", "yo</s>", "[INST] bye [/INST]", "ok</s>"]),
        ("qwen", "S", ["<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n", "yo</s>", "\n<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\n", "ok</s>"]),
        ("chatglm2", "", ["[gMASK]sop[Round 0]\n\n问：hi\n\n答：", "yo", "\n\n[Round 1]\n\n问：bye\n\n答：", "ok"]),
        ("llama2", "S", ["<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nhi [/INST]", "yo</s>", "<s>[INST] bye [/INST]", "ok</s>"]),
        ("intern", "", ["<|User|>:hi<eoh>\n<|Bot|>:", "yo", "<eoa>\n<|User|>:bye<eoh>\n<|Bot|>:", "ok"]),
        ("deepseekcoder", "S", ["S### Instruction:\nhi\n### Response:", "\nyo", "\n<|EOT|>\n### Instruction:\nbye\n### Response:", "\nok"]),
        ("zephyr", "S", ["<|system|>\nS</s><|user|>\nhi</s><|assistant|>", "yo</s>", "<|user|>\nbye</s><|assistant|>", "ok</s>"]),
    ],
)
def test_render(spark, template, system, expected):
    assert render(spark, template, CHAT_MSGS, system) == expected


def test_render_function_and_observation(spark):
    call = json.dumps({"name": "f", "arguments": {"a": [1, 2], "b": "x, y: \"z\""}})
    got = render(spark, "default", [("user", "q"), ("function", call), ("observation", "42"), ("assistant", "a")])
    assert got[1] == 'Action: f\nAction Input: {"a": [1, 2], "b": "x, y: \\"z\\""}</s>'
    assert got[2] == "\nHuman: 42\nAssistant: "
    assert render(spark, "chatglm3", [("user", "q"), ("function", "no json")])[1] == "\n"
    with pytest.raises(PySparkException, match="unexpected role"):
        render(spark, "default", [("nobody", "q")])


@pytest.mark.parametrize("template", ["alpaca", "chatglm3", "llama2_zh", "starchat"])
def test_rows_render_like_conversations(spark, template):
    renderer = R.Renderer(Tm.get_template(template), "<s>", "</s>")
    rows = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(CHAT_MSGS)], "i int, role string, content string")
    text = renderer.row_text(F.col("role"), F.col("content"), F.col("i"), F.lit("S"), None)
    assert [r[0] for r in rows.orderBy("i").select(text).collect()] == render(spark, template, CHAT_MSGS, "S")
    tokens = renderer.row_tokens(F.col("role"), F.col("content"), F.col("i"), F.lit("S"), None, Tk.whitespace)
    nested = spark.createDataFrame([(CHAT_MSGS,)], "m array<struct<role:string,content:string>>")
    whole = nested.select(renderer.tokens(F.col("m"), F.lit("S"), None, Tk.whitespace)).first()[0]
    assert [r[0] for r in rows.orderBy("i").select(tokens).collect()] == whole


def test_content_with_placeholder_is_kept(spark):
    assert render(spark, "chatglm2", [("user", "{{idx}} {{content}}")])[0] == "[gMASK]sop[Round 0]\n\n问：{{idx}} {{content}}\n\n答："


def test_render_tools(spark):
    tools = [
        {"name": "t1", "description": "d1", "parameters": {"properties": {"z": {"type": "string", "description": "zz", "enum": ["p", "q"]}, "a": {"type": "array", "items": {"type": "int"}}}, "required": ["z"]}},
        {"name": "t2", "parameters": {"properties": {}}},
    ]
    bad = ["", "[]", "nope", '[{"description": "no name", "parameters": {"properties": {}}}]']
    df = spark.createDataFrame([(json.dumps(tools),)] + [(b,) for b in bad], "t string")
    out = [r[0] for r in df.select(R.render_tools(F.col("t"))).collect()]
    assert out[1:] == [""] * len(bad)
    assert out[0] == (
        "You have access to the following tools:\n"
        "> Tool Name: t1\nTool Description: d1\nTool Args:\n"
        "  - z (string, required): zz, should be one of [p, q]\n  - a (array): , where each item should be int\n\n"
        "> Tool Name: t2\nTool Description: \nTool Args:\n\n"
        "Use the following format if using a tool:\n```\nAction: tool name (one of [t1, t2]).\n"
        'Action Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{"input": "hello world", "num_beams": 5}```).\n```\n'
    )


def test_extract_action(spark):
    texts = ['Action: f\nAction Input: {"a":1}', 'x Action: g_1 y\nAction Input: ```"{"b": [1,2]}"```', "Action: f\nAction Input: not json", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(R.extract_action(F.col("t"))).collect()]
    assert got[0] == (True, "f", '{"a": 1}')
    assert got[2] == (False, None, texts[2]) and got[3] == (False, None, "plain")


def test_template_table(spark):
    rows = {r["name"]: r for r in Tm.templates_df(spark).collect()}
    assert len([t for t in Tm.TEMPLATES if t != "question_answer"]) == 36
    assert rows["chatml"]["eos"] == "<|im_end|>" and rows["chatml"]["additional_tokens"] == ["<|im_start|>"]
    assert rows["vicuna"]["eos"] == "<|endoftext|>" and rows["vicuna"]["pad"] == "<|endoftext|>"
    assert [s["kind"] for s in rows["vicuna"]["assistant_slots"]] == ["text", "eos"]
    assert [s["kind"] for s in rows["falcon"]["assistant_slots"]] == ["text"]
    assert rows["chatglm3"]["observation_slots"] != rows["chatglm3"]["user_slots"]
    assert sum(r["inline_system"] for r in rows.values()) == 2
    with pytest.raises(ValueError, match="does not exist"):
        Tm.get_template("nope")


# Tokens


def test_tokenizers(spark):
    texts = ["", "  ", " a  b\n", "été, x_1!", "\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(Tk.whitespace(F.col("t"))).collect()] == [t.split() for t in texts]
    assert [r[0] for r in df.select(Tk.characters(F.col("t"))).collect()] == [list(t) for t in texts]
    assert df.select(Tk.words_and_marks(F.col("t"))).collect()[3][0] == ["é", "t", "é", ",", "x_1", "!"]


def test_ids_and_back(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, []), (2, ["c", "zz"]), (3, None)], "k long, t array<string>")
    vocab = Tk.build_vocab(df, "t", 4, ["<unk>", "</s>"])
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"<unk>": 0, "</s>": 1, "b": 2, "a": 3}
    expected = {0: [2, 3, 2], 1: [], 2: [0, 0], 3: None}
    ids = Tk.to_ids(df, "t", vocab, "ids")
    assert {r["k"]: r["ids"] for r in ids.collect()} == expected
    assert {r["k"]: r["ids"] for r in Tk.to_ids_by_join(df, "k", "t", vocab, "ids").collect()} == expected
    assert Tk.decode(ids.where("k = 0"), "ids", vocab, "x", skip=2).first()["x"] == "a"
    with pytest.raises(RuntimeError, match="no valid example"):
        Tk.preview(ids.where("k > 9"), "k", "ids", vocab)


# Registry, readers, sinks


def test_registry(spark, tmp_path):
    entries = {
        "local": {"file_name": "a.json", "file_sha1": "x"},
        "both": {"hf_hub_url": "h", "ms_hub_url": "m", "script_url": "s", "subset": "sub"},
        "ms": {"ms_hub_url": "m"},
        "script": {"script_url": "s", "columns": {"prompt": "text"}},
        "chat": {"file_name": "c.json", "formatting": "sharegpt", "columns": {"messages": "m"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"}},
    }
    path = tmp_path / "info.json"
    path.write_text(json.dumps(entries, indent=2))
    reg = registry.load_registry(spark, str(path))
    specs = registry.resolve(reg, " both , ms,script,local,chat")
    assert [s.load_from for s in specs] == ["hf_hub", "ms_hub", "script", "file", "file"]
    assert specs[0].subset == "sub" and specs[0].prompt == "instruction"
    assert specs[2].prompt == "text" and specs[2].query is None and specs[2].response is None
    assert specs[4].role_tag == "role" and specs[4].system_tag is None and specs[4].messages == "m"
    assert [r["name"] for r in registry.resolve_rows(reg, "ms,local").orderBy("dataset_idx").collect()] == ["ms", "local"]
    with pytest.raises(ValueError, match="undefined dataset"):
        registry.resolve(reg, "local,nope")
    with pytest.raises(PySparkException, match="undefined dataset nope"):
        registry.resolve_rows(reg, "local,nope").collect()


def test_read_dataset(spark, tmp_path):
    data = [{"a": i, "text": f"line {i}\nnext \"q\", é"} for i in range(5)]
    (tmp_path / "x.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(d) for d in data))
    (tmp_path / "x.txt").write_text("l1\nl2\n")
    table = pa.Table.from_pylist(data)
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    folder = tmp_path / "arrows"
    folder.mkdir()
    for i in range(2):
        with pa.OSFile(str(folder / f"{i}.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
    for name in ("x.json", "x.jsonl", "x.arrow"):
        got = sorted((r["a"], r["text"]) for r in readers.read_dataset(spark, str(tmp_path / name)).collect())
        assert got == [(d["a"], d["text"]) for d in data]
    assert readers.read_dataset(spark, str(folder)).count() == 10
    assert [r["text"] for r in readers.read_dataset(spark, str(tmp_path / "x.txt")).collect()] == ["l1", "l2"]
    with pytest.raises(ValueError, match="more than one format"):
        readers.check_homogeneous(spark, str(tmp_path))
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.xyz").write_text("x")
    with pytest.raises(ValueError, match="txt, csv, json or jsonl"):
        readers.read_dataset(spark, str(tmp_path / "z"))


def test_checksums(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abd")
    (tmp_path / "c.txt").write_bytes(b"c")
    reg = spark.createDataFrame([("a.txt", hashlib.sha1(b"abc").hexdigest()), ("b.txt", "0")], "file_name string, file_sha1 string")
    got = {r["file_name"]: r["status"] for r in readers.verify_checksums(spark, str(tmp_path), reg).collect()}
    assert got == {"a.txt": "ok", "b.txt": "mismatch", "c.txt": "missing hash"}
    files = spark.createDataFrame([("d", b"1"), ("d", b"2")], "name string, content binary")
    assert readers.checksum_status(files, spark.createDataFrame([("d", "x")], "name string, file_sha1 string")).first()["status"] == "too many files"


def test_cache_is_written_once(spark, tmp_path):
    path = str(tmp_path / "c")
    assert cache.cached(spark, path, lambda: spark.range(3)).count() == 3
    assert cache.cached(spark, path, lambda: pytest.fail("built again")).count() == 3
    scores = str(tmp_path / "s")
    make = lambda v: lambda: spark.createDataFrame([(0, v)], "layer int, score double")
    assert cache.cached_scores(spark, scores, "r1", make(1.0)).first()["score"] == 1.0
    assert cache.cached_scores(spark, scores, "r2", make(2.0)).first()["score"] == 2.0
    assert cache.cached_scores(spark, scores, "r1", make(9.0)).first()["score"] == 1.0


def test_metric_lines(spark, tmp_path):
    rows = [("ppl", 5.36), ("throughput_tok_per_s", 30.456), ("peak_mem_mib", 512.0), ("num_eval_tokens", 400.0)]
    df = spark.createDataFrame(rows, "metric string, value double")
    sinks.write_metrics(df, str(tmp_path / "m"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    assert lines == ["num_eval_tokens=400", "peak_mem_mib=512.0", "ppl=5.3600", "throughput_tok_per_s=30.46"]
    back = {r["metric"]: r["value"] for r in readers.read_kv_metrics(spark, str(tmp_path / "m")).collect()}
    assert back == {"ppl": 5.36, "throughput_tok_per_s": 30.46, "peak_mem_mib": 512.0, "num_eval_tokens": 400.0}
    assert sinks.to_markdown(df.orderBy("metric")).splitlines()[0] == "| metric | value |"
    sinks.write_loss_log(spark.createDataFrame([(i, i / 2) for i in range(20)], "pos long, nll double"), str(tmp_path / "l"), ["pos"])
    assert [float(r["value"]) for r in spark.read.text(str(tmp_path / "l")).collect()] == [i / 2 for i in range(20)]


def test_call_arguments_that_are_text_or_hold_their_own_name(spark):
    calls = ['{"name":"f","arguments":{"arguments":"x"}}', '{"name":"f","arguments":"a\\"b"}', '{"name":"f","arguments":[1,"ü"]}', '{"name":"f"}']
    df = spark.createDataFrame([(c,) for c in calls], "c string")
    out = [r[0] for r in df.select(R.render_function_call(F.col("c"), "{{arguments}}")).collect()]
    assert out == ['{"arguments": "x"}', '"a\\"b"', '[1, "ü"]', ""]


def test_large_vocabularies_are_joined_with_the_same_result(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["z"]]), (2, [["b"], []]), (3, None)], "k int, t array<array<string>>")
    vocab = spark.createDataFrame([("<unk>", 0), ("a", 1), ("b", 2)], "token string, token_id int")
    expected = {1: [[1, 2], [0]], 2: [[2], []], 3: None}
    for bound in (1_000, 0):
        assert {r["k"]: r["i"] for r in Tk.to_ids(df, "t", vocab, "i", bound=bound).collect()} == expected
    ids = spark.createDataFrame([(1, [1, -100, 2])], "k int, i array<int>")
    for bound in (1_000, 0):
        assert Tk.decode(ids, "i", vocab, "x", skip=-100, bound=bound).first()["x"] == "a b"


def test_folder_with_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n[\n  {"x": 1},\n  {"x": 2},\n  {"x": 3}\n]')
    (tmp_path / "b.json").write_text('{"x": 4}\n{"x": 5}\n{"x": 6}\n')
    assert sorted(r["x"] for r in readers.read_dataset(spark, str(tmp_path), schema="x int").collect()) == [1, 2, 3, 4, 5, 6]
    assert readers.read_dataset(spark, str(tmp_path)).count() == 6


def test_lookups_go_piece_by_piece(spark):
    """Batches are cut by their list elements; a join meets a piece's distinct elements, not every row's."""
    rows = [(k, [["a", "b", None][: k % 4], ["c"] * (k % 7)], ["b", "zz"] * (k % 3)) for k in range(40)] + [(40, None, []), (41, [None, []], None)]
    df = spark.createDataFrame(rows, "k long, t array<array<string>>, u array<string>").coalesce(1)
    vocab = spark.createDataFrame([("<unk>", 0), ("a", 1), ("b", 2), ("c", 3)], "token string, token_id int")
    ids = {"a": 1, "b": 2, "c": 3}
    nested = lambda x: None if x is None else [nested(y) if isinstance(y, list) else ids.get(y, 0) for y in x]
    want = [(k, [None if y is None else nested(y) for y in t] if t is not None else None, nested(u)) for k, t, u in rows]
    for bound in (Tk.VOCAB_BYTES, -1):
        out = Tk.to_ids(df, {"t": "t", "u": "v"}, vocab, bound=bound)
        assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == want and out.columns == ["k", "t", "v"]
    batch = pa.RecordBatch.from_pydict({"t": [[["x"] * 3], None, [["x"], ["x"] * 4], [], [["x"] * 9], [["x"]]]})
    assert [b.num_rows for b in Tk.pieces(batch, ["t"], 4)] == [2, 1, 1, 1, 1]
    assert [b.num_rows for b in Tk.pieces(batch.slice(2), ["t"], 5)] == [2, 1, 1]
