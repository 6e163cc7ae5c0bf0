"""Pieces of texts beside a plain loop, and checks as texts."""

import random
import re

from pyspark.sql import functions as F

from opslens.functions import architecture


def plain_chunks(text, most):
    out, held = [], []
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text.strip())):
        for part in re.split(r"(?<=[。；;\n])", paragraph) if len(paragraph) > most else [paragraph]:
            if not part.strip():
                continue
            if held and sum(len(x) + 1 for x in held) + len(part) + 1 > most:
                out.append("\n".join(held).strip())
                held = []
            held.append(part)
    return [x for x in [*out, "\n".join(held).strip()] if x]


def test_chunks(spark):
    rnd = random.Random(5)
    texts = ["", "  \n\n ", *("".join(rnd.choice(["ab", "。", "；", "\n", "\n\n", " ", "字", "x;"]) for _ in range(rnd.randrange(200))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, text string")
    for r in df.select("text", architecture.chunks(F.col("text"), 30).alias("parts")).collect():
        assert r.parts == plain_chunks(r.text or "", 30)


def test_checks_and_addresses(spark):
    df = spark.sql("select array(named_struct('title', ' t ', 'check_id', 'c', 'reason', '', 'manual_command_hint', 'h'), named_struct('title', '', 'check_id', 'c', 'reason', 'r', 'manual_command_hint', null)) as x, map('ips', '[\"1.2.3.4\", \"01.2.3.4\", \"1.2.3\", \"fe80::1\"]') as m, cast(null as map<string,string>) as n")
    r = df.select(architecture.flattened_checks(F.col("x")).alias("c"), architecture.runtime_meta(F.col("m")).alias("m"), architecture.runtime_meta(F.col("n")).alias("n")).first()
    assert r.c == ["t；h", "c；r"] and r.m == {"ips": ["1.2.3.4", "fe80::1"]} and r.n == {}
