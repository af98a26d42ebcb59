"""Boundary values of options parsing and provider limits."""

import json
import random
import string
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sluice.functions import options as O, pubsub, sqs
from sluice.functions.once import compute_once
from sluice.functions.values import as_timestamp


def verdicts(spark, values, expression, kind="string"):
    rows = [(n, v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"n int, v {kind}")
    return [r[0] for r in df.selectExpr("n", f"{expression} AS x").orderBy("n").select("x").collect()]


def test_topics(spark):
    """Names: a letter first, 3 to 255 of letters, digits and -._~+%, not beginning with goog; bare or in a project."""
    rest = "-._~+%9Zz"
    good = [first + rest[:n] for first in "aZ" for n in (2, 9)] + ["x" + "7" * 254, f"projects/any.where/topics/k{rest}"]
    bad = ["", "x7", "x" + "7" * 255, *[c + "mail" for c in "9-._~+%"], *[f"ma{c}il" for c in " !#$&*/:@é\t"], "gOogle", "goog.x",
           "projects/any.where/topics/x7", "projects/any.where/topics/goOg1", "topics/mail1", "projects/any.where/mail1"]
    assert verdicts(spark, good + bad, pubsub.topic_valid("v")) == [True] * len(good) + [False] * len(bad)


def test_pubsub_attributes(spark):
    """At most 100 entries, names of 1 to 256 bytes that do not begin with goog, values of at most 1024 bytes."""
    full = {f"{n:03d}": str(n) for n in range(99)}
    limits = {**full, "n" * 256: "w" * 1024}
    good = [None, {}, full, limits, {"my-goog": ""}]
    bad = [{**limits, "z": ""}, {**full, "n" * 257: ""}, {**full, "z": "w" * 1025}, {"": "set"}, {"googol": ""}, {"gOOG": ""}]
    assert verdicts(spark, good + bad, pubsub.attributes_valid("v"), "map<string,string>") == [True] * len(good) + [False] * len(bad)


def test_pubsub_poison(spark):
    made = [("10000000", "", "abc"), ("10000001", "", "abc"), ("0", "key", "abc"), ("0", "", "abc"), ("1", "", "bad/topic")]
    df = spark.createDataFrame(made, "n string, k string, t string").coalesce(1).selectExpr("repeat('x', CAST(n AS INT)) AS d", "k", "t")
    reasons = df.selectExpr(f"{pubsub.poison_reason('t', 'CAST(d AS BINARY)', 'k', 'CAST(NULL AS MAP<STRING, STRING>)')} AS r").collect()
    assert [r["r"] for r in reasons] == [None, pubsub.TOO_LARGE, None, pubsub.EMPTY_MESSAGE, pubsub.BAD_TOPIC]


def test_queue_urls(spark):
    good = ["queue-a", "https://sqs.eu/1/q", "http://localhost:9324/queue/q", "HTTPS://host/q", "https://u:p@host/q", "/path", "q%20a", "http://:80/q",
            "q?x=a:b", "https://[::1]:80/q", "https://host//q"]
    bad = ["", "a b", "a\tb", "ftp://host/q", "https:///q", "https://host", "https://host/", "https://host//", "q%zz", "%", ":q", "1a:b", "a:b",
           "a\x01b", "https://host:port/q", "https:q", "https://host?x=/q", "https://host#/q"]
    found = verdicts(spark, good + bad, sqs.queue_valid("v"))
    assert [v for v, ok in zip(good + bad, found) if ok] == good


def test_sqs_text(spark):
    good = [b"body", b"body\t\n\r", "é\U0001f600".encode(), "퟿�".encode()]
    bad = [b"\xff", b"\x01", b"\x1f", "￾".encode(), b"ok\xc3"]
    assert verdicts(spark, [bytearray(v) for v in good + bad], sqs.text_valid("CAST(v AS STRING)"), "binary") == [True] * 4 + [False] * 5


ATTRIBUTE = "struct<data_type:string,string_value:string,binary_value:binary,error:string>"


LETTERS = "abcxyzABCXYZ0189_-"


def attribute_allowed(name, kind, said, data):
    """The rule: a name of 1 to 256 letters, digits, _ - and single inner dots, no reserved start; one non-empty value that fits the type."""
    named = (0 < len(name) <= 256 and set(name) <= set(string.ascii_letters + string.digits + "_-.") and "" not in name.split(".")
             and not name.lower().startswith(("aws.", "amazon.")))
    base = kind.split(".")[0]
    if base == "Binary":
        return named and bool(data) and said is None
    return named and base in ("String", "Number") and data is None and bool(said) and all(c in "\t\n\r" or c >= " " for c in said)


def test_sqs_attributes(spark):
    """Random attributes against the rule, alone and eleven at a time."""
    rng, cases = random.Random(21), [None, {}]
    for _ in range(400):
        name = ".".join("".join(rng.choices(LETTERS, k=rng.choice([0, 1, 3, 3, 5, 5, 5, 90]))) for _ in range(rng.choice([1, 1, 2, 3])))
        name = rng.choice([""] * 6 + ["aWs.", "AmaZon.", "awsm", "."]) + name + rng.choice([""] * 8 + [".", " ", "é", "/"])
        kind = rng.choice(["String", "Number", "Binary"] * 2 + ["Strin", "binary", ""]) + rng.choice(["", "", ".custom"])
        fitting = (None, bytearray(b"z")) if kind.startswith("Binary") else (rng.choice(["v", "7"]), None)
        odd = rng.choice([None, "", "v", "7", "a\x02"]), rng.choice([None, None, bytearray(b""), bytearray(b"z")])
        cases.append({name: (kind, *rng.choice([fitting, fitting, odd]), None)})
    cases += [{f"n{i}": ("String", "v", None, None) for i in range(n)} for n in (9, 10, 11, 12)]
    cases += [{"n" * n: ("Number", "1", None, None)} for n in (255, 256, 257)]
    wanted = [c is None or len(c) <= 10 and all(attribute_allowed(n, *v[:3]) for n, v in c.items()) for c in cases]
    assert 40 < sum(wanted) < len(wanted) - 40
    assert verdicts(spark, cases, sqs.attributes_valid("v"), f"map<string,{ATTRIBUTE}>") == wanted


def test_sqs_poison(spark):
    """Random entries against the rule: a body of 1 byte to 1 MiB of allowed text, ids of up to 128 printable characters, a delay of 0 to 900."""
    rng, printable = random.Random(22), [chr(c) for c in range(33, 127)]
    shown = "".join(printable)

    def an_id():
        return "".join(rng.choices(printable, k=rng.choice([0, 0, 1, 20, 127, 128, 129]))) + rng.choice(["", "", "", "", " ", "\n", "ü"])

    rows = [(rng.choice([0, 1, 500, 1_048_575, 1_048_576, 1_048_577]), rng.choice(["78", "78", "78", "78", "C3", "0B"]), an_id(), an_id(),
             rng.choice([None, None, 0, rng.randint(1, 899), 900, 901, -rng.randint(1, 9)])) for _ in range(150)]
    wanted = [n == 0 or n > 1 << 20 or fill != "78" or any(len(i) > 128 or set(i) - set(shown) for i in (group, dedup)) or not (d is None or 0 <= d <= 900)
              for n, fill, group, dedup, d in rows]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n int, fill string, g string, u string, d int").repartition(8)
    poison = sqs.is_poison("b", f"CAST(NULL AS MAP<STRING, {ATTRIBUTE}>)", "g", "u", "d")
    found = df.selectExpr("k", "unhex(repeat(fill, n)) AS b", "g", "u", "d").selectExpr("k", f"{poison} AS p").collect()
    assert [r["p"] for r in sorted(found)] == wanted and 10 < sum(wanted) < 140


def test_base64(spark):
    values = ["SGVsbG8=", "SGVs\r\nbG8=", "", "SGVsbG8", "!!", "SGVsbG8==", "SGVs bG8="]
    found = verdicts(spark, values, O.strict_base64("v"))
    assert found == [bytearray(b"Hello"), bytearray(b"Hello"), bytearray(b""), None, None, None, None]


def sections(spark, raw, target="pubsub"):
    rows = [(n, r, target) for n, r in enumerate(raw)]
    df = spark.createDataFrame(rows, "n int, raw string, target string")
    read = compute_once(df, df.columns, {"p": O.parse_options("raw")})
    read = compute_once(read, ["n", "target"], {"s": O.section_of("p", "target", ["pubsub", "sqs"]), "root": O.root_error("raw", "p")})
    return read.withColumn("err", F.expr(f"coalesce(root, {O.section_error('s', 'target')})")).orderBy("n")


def test_option_documents(spark):
    """Random documents, some cut or run together, against a strict reader: an object or nothing, and so its section."""
    rng = random.Random(23)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [None, rng.randint(-9, 99), "".join(rng.choices('ab" {}[],:é\\', k=3)), True, 1.5][kind]
        return [value(depth - 1) for _ in range(2)] if kind == 5 else {rng.choice(["pubsub", "orderingKey", "x"]): value(depth - 1) for _ in range(2)}

    raws = [None, "", "  null "]
    for _ in range(300):
        document = {k: value(2) for k in rng.sample(["pubsub", "sqs", "z"], 2)}
        if rng.random() < 0.5:
            document["pubsub"] = {"orderingKey": rng.choice(["k", "", None, 7, ["k"]]), "more": value(1)}
        raw = json.dumps(rng.choice([document, document, document, value(2)]), ensure_ascii=rng.random() < 0.5)
        raws.append(rng.choice([raw, raw, raw, " " + raw + "\n", raw[:rng.randrange(len(raw))], raw + raw, raw + " x", raw.replace(":", ":0", 1)]))

    def read(raw):
        try:
            root = json.loads(raw) if raw else None
        except ValueError:
            return False, ""
        section = root.get("pubsub") if isinstance(root, dict) else None
        sound = (root is None or isinstance(root, dict)) and (section is None or isinstance(section, dict))
        key = section.get("orderingKey") if sound and section else None
        return sound, key if isinstance(key, str) else ""

    rows = sections(spark, raws).selectExpr("err", f"CASE WHEN err IS NULL THEN {O.string_value('s', 'orderingKey')} ELSE '' END AS k").collect()
    assert [(r["err"] is None, r["k"]) for r in rows] == [read(r) for r in raws]
    reasons = {r["err"] for r in rows if r["err"]}
    assert reasons == {f"malformed event options: {what}" for what in ("options column must be valid JSON", "options column must be an object",
                                                                       "pubsub section must be an object")}


def test_typed_fields(spark):
    raw = ['{"pubsub":{"orderingKey":42}}', '{"pubsub":{"attributes":[]}}', '{"pubsub":{"attributes":{"keep":"yes","drop":42,"also":null}}}']
    rows = sections(spark, raw).selectExpr(
        f"{O.string_error('s', 'orderingKey')} AS ke", f"{O.object_error('s', 'attributes')} AS ae", f"{O.object_value('s', 'attributes')} AS a")
    rows = rows.selectExpr("ke", "ae", f"{O.kept_attributes('a')} AS kept", f"{O.dropped_attributes('a')} AS gone").collect()
    assert rows[0]["ke"] == "malformed event options: orderingKey must be a string"
    assert rows[1]["ae"] == "malformed event options: attributes must be an object"
    assert (rows[2]["kept"], rows[2]["gone"]) == ({"keep": "yes"}, ["also", "drop"])


def test_sqs_fields(spark):
    docs = ['{"delaySeconds":30.0}', '{"delaySeconds":"3"}', '{"delaySeconds":30.5}', '{"delaySeconds":3000000000}', '{"delaySeconds":null}',
            '{"messageSystemAttributes":{}}', '{"messageSystemAttributes":{"AWSTraceHeader":""}}', '{"messageSystemAttributes":{"AWSTraceHeader":"R"}}',
            '{"messageSystemAttributes":{"Other":"x"}}', '{"messageSystemAttributes":{"AWSTraceHeader":"R","b":1}}',
            '{"messageSystemAttributes":{"AWSTraceHeader":5}}', '{"messageSystemAttributes":[]}',
            '{"attributes":{"b":{"DataType":""},"a":{"DataType":"String","StringListValues":null}}}', '{"attributes":{"x":5}}']
    df = sections(spark, [f'{{"sqs":{d}}}' for d in docs], "sqs")
    df = compute_once(df, ["n", "s"], {"a": O.sqs_attributes("s")})
    rows = df.selectExpr(f"{O.delay_value('s')} AS d", f"{O.delay_error('s')} AS de", f"{O.trace_value('s')} AS t", f"{O.trace_error('s')} AS te",
                         f"{O.sqs_attributes_error('s', 'a')} AS ae").collect()
    assert [r["d"] for r in rows[:5]] == [30, None, None, None, None]
    assert [r["de"] is None for r in rows[:5]] == [True, False, False, False, True]
    assert [r["te"] is None for r in rows[5:12]] == [True, False, True, False, False, False, False]
    assert rows[7]["t"] == "R"
    assert rows[12]["ae"] == "malformed event options: attribute a: StringListValues is reserved by SQS and not supported"
    assert rows[13]["ae"] == "malformed event options: attribute x: must be a MessageAttributeValue object"


def test_timestamps(spark):
    """Random instants in the accepted layouts against the instants themselves; anything shorter or longer is none."""
    rng, values, wanted = random.Random(24), [None], [None]
    for _ in range(200):
        moment = datetime(rng.randint(1990, 2090), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60), rng.randrange(60),
                          rng.choice([0, 0, rng.randrange(10**6)]), timezone.utc)
        offset = rng.choice([None, 0, rng.randrange(-11, 12) * 60 + rng.choice([0, 30])])
        local = moment if offset is None else moment.astimezone(timezone(timedelta(minutes=offset)))
        fraction = f".{moment.microsecond:06d}".rstrip("0") if moment.microsecond else ""
        zone = "" if offset is None else "Z" if offset == 0 else f"{'-' if offset < 0 else '+'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}"
        text = f"{local:%Y-%m-%d}{' ' if offset is None else 'T'}{local:%H:%M:%S}{fraction}{zone}"
        broken = rng.choice([None, None, text[:10], text[:4], text[:13], "at " + text, text + " x", text.replace("-", "/"), text.replace(" ", "T") if offset is None else text[:19], ""])
        values.append(text if broken is None else broken)
        wanted.append(None if broken is not None else (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1))
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    found = [r[0] for r in df.orderBy("n").selectExpr(f"unix_micros({as_timestamp('v', df.schema['v'].dataType)})").collect()]
    assert found == wanted


def test_safe_ids(spark):
    found = verdicts(spark, ["abc-_1", "a" * 80, "a" * 81, "a b", "abc\n"], sqs.safe_id("v", sqs.ENTRY_ID))
    assert found[:2] == ["abc-_1", "a" * 80] and all(len(v) == 64 for v in found[2:])


@pytest.mark.parametrize("code, permanent", [("400", True), ("InvalidArgument", True), ("OutOfRange", True), ("503", False), (None, False)])
def test_permanent_codes(spark, code, permanent):
    assert verdicts(spark, [code], pubsub.permanent_error("v")) == [permanent]
