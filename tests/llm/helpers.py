"""Small tables with awkward rows, and comparison with DuckDB."""

import collections
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "the of and la der que alpha beta gamma delta idiot scum kappa lambda omega Token SECRET".split()
PASSAGE = " ".join(f"bench{i} word{i % 7}" for i in range(12))


def documents(extra=False):
    """Rows with nulls, empty and very long texts, ties, copies and a hot source."""
    rng = random.Random(5)

    def prose(n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "\n", "é"]) for _ in range(n))

    base = [prose(rng.randint(1, 120)) for _ in range(24)]
    long = prose(4_000)
    texts = [None, "", " \t\n", "one", "one", "two words", *base, base[0], base[1] + " tail", long, long + " end"]
    texts += [f"{base[2]} {PASSAGE} {base[3]}", PASSAGE.upper(), "bench3 word3 bench4", "tiny item", "x tiny ITEM y"]
    texts += ['token = "abcdefgh" ' + base[4], "AKIA" + "Z" * 20 + " passwd: short password: longenough1", "0123456789abcdef01234567 " * 3]
    texts += ["token: token: abcdefgh", "secret=" + "Ab1-" * 9, "Ab1_" * 8 + " é Xy9/" * 2, "boiler line\nother\nboiler line", "boiler line\n\n"] * 2
    texts += ["MIT License, Apache-License. GNU General\nPublic License; CC BY-NC 4.0 (CC-BY)", "the mit license mit license", "summit license é mit\u00e9 license", "// SPDX-License-Identifier: MIT */ x"]
    texts += ["# spdx license_identifier = (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\nSPDX-License-Identifier: LGPL-2.1+ WITH", "License-Expression: Apache-2.0 or (\n"]
    texts += ["SPDX-License-Identifier: (MIT WITH x) WITH y\nlicense expression:((AGPL-3.0)) and x", "SPDX-License-Identifier:", "xspdx-license-identifier: MIT", "kitchens kitchen kitchens kitchen kitchen kitchxn mitchen kitchens " * 9, "différent different différent ×÷ÿÀéèêÂÎ Kitchen KITCHEN kitchen " * 7]
    texts += ["<|startoftext|> Mixed <|ENDOFTEXT|> it's I'LL 1234 ñÑ é K", " nb sp\u0085x"]
    rows = {
        "doc_id": list(range(len(texts))),
        "text": texts,
        "lang": [None if i % 5 == 0 else "en" for i in range(len(texts))],
        "source": [None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 8}" for i in range(len(texts))],
        "n_chars": [len(t) if t is not None else None for t in texts],
    }
    table = pa.table(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    table = pa.concat_tables([table, table.slice(8, 3)])  # repeated rows
    return clashing(table) if extra else table


def clashing(table):
    """The table with columns more whose names the operators use for themselves."""
    names = "k_id k_hash node key h x_h x_n x_gone spans size m words score hashes place part head digest host path src dst w verdict rule kind item item_id html url toxic quality site owner value n f1 f2 g turn_no code seg part at said place"
    for name in names.split():
        if name not in table.column_names:
            table = table.append_column(name, pa.array(["clash"] * len(table)))
    return table


def benchmark():
    texts = [None, "", PASSAGE, PASSAGE.replace("bench5", "other5"), "tiny item", "one", "never seen anywhere at all in these rows"]
    return pa.table({"item_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def pages():
    urls = [
        None,
        "no scheme",
        "http://",
        "http://A.Example.COM/en/7?x",
        "https://x.com/en/1#f",
        "http://b.example.net/de/8",
        "http://b.example.net/de/9",
        "http://c.org/es/1",
        "http://c.org/fr/1",
        "ftp://notexample.com/en/7",
        "://h.org?q=/es/",
        "http://com/en/",
    ]
    html = [None, "", '<a href="http://c.org/x">', "<a href=//x.com>", "<a HREF='https://B.example.net/z'>"]
    rows = [(i, u, html[i % 5]) for i, u in enumerate(urls * 3)]
    return pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string())})


def labels():
    ids = list(range(0, 55))
    return pa.table({"doc_id": pa.array([*ids, None, 3], pa.int64()), "quality": pa.array([1] * 57, pa.int32()), "toxic": pa.array([*(int(i % 4 == 0) for i in ids), 1, None], pa.int32())})


def conversations(seed=9):
    """Short and long conversations with nulls in every column, odd roles, blank and repeated turns, ties and gaps."""
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]
    texts = ["Yes.", "No!", "Why?", "cut off", "  \t", "", None, "é.", "end. \n", "a\nb", "..."]
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "assistant", "x"), (8, 1, None, None)]
    for conv in range(60):
        turn = rng.choice([0, 1, -2])
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            rows.append((conv, turn if rng.random() > 0.03 else None, rng.choice(roles[: rng.choice([2, 3, 9])]), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 1, 2])
    rows += rows[10:14]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return pa.table({name: [r[i] for r in rows] for i, name in enumerate(schema.names)}, schema)


def write(folder, empty=False, extra=False):
    """Write the tables; returns the folder as a string."""
    for name, t in {"documents": documents(extra), "benchmark": benchmark(), "pages": pages(), "labels": labels(), "conversations": conversations()}.items():
        t = clashing(t) if extra else t
        pq.write_table(t.slice(0, 0) if empty else t, folder / f"{name}.parquet")
    return str(folder)


def same_as_duckdb(df, sql, folder):
    """Assert that both give the same rows, in any order."""
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = collections.Counter(map(str, found.fetchall()))
    got = collections.Counter(str(tuple(r[n] for n in names)) for r in df.collect())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])
