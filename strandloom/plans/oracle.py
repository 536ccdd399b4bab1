"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from strandloom.plans.queries import ANCHOR_K, CUTOFF, EVENT_K, EVENT_SHARE, LEAST, MAP_K, K
from strandloom.plans.tables import CONTIG, OVERLAP

_ALPHABET, _BASES = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]


def _encode(text: str) -> str:
    return f"translate(regexp_replace(lower(coalesce({text}, '')), '[^a-z]', '', 'g'), '{_ALPHABET}', '{_BASES}')"


def _rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def _code(s: str, k: int) -> str:
    """2-bit code of a string of k bases, in the order A, C, T, G."""
    return " + ".join(f"(instr('ACTG', substr({s}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))


def _kmers(relation: str, keep: str, k: int) -> str:
    return f"SELECT {keep}, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {relation} WHERE length(seq) >= {k})"


SEQS = f"""
seqs AS (SELECT doc_id AS read_index, coalesce(source, '') = 'src0' AS transcript, {_encode("text")} AS seq FROM documents),
sr AS (SELECT * FROM seqs WHERE NOT transcript), tr AS (SELECT * FROM seqs WHERE transcript)"""
_STEP = CONTIG - OVERLAP
ITEMS = f"""
whole AS (SELECT * FROM (SELECT item_id AS unitig_id, {_encode("text")} AS seq FROM benchmark) WHERE seq <> ''),
items AS (
  SELECT unitig_id * 1000000 + p AS unitig_id, substr(seq, p * {_STEP} + 1, {CONTIG}) AS seq
  FROM (SELECT unitig_id, seq, unnest(range(0, greatest(1, CAST(ceil((length(seq) - {OVERLAP}) / {_STEP}.0) AS BIGINT)))) AS p FROM whole))"""


def _counted(relation: str, least: int) -> str:
    return f"SELECT least(kmer, {_rc('kmer')}) AS kmer, count(*) AS n FROM ({_kmers(relation, 'read_index', K)}) GROUP BY 1 HAVING count(*) >= {least}"


def _edges(name: str, solid: str) -> str:
    return f"""
{name}_o AS (SELECT kmer, n FROM {solid} UNION SELECT {_rc("kmer")}, n FROM {solid}),
{name} AS (
  SELECT a.kmer AS u, b.kmer AS v, b.n FROM {name}_o a JOIN {name}_o b ON substr(a.kmer, 2) = substr(b.kmer, 1, {K - 1}))"""


WEAK = f"""
solid AS ({_counted("sr", LEAST)}), {_edges("g", "solid")},
weak0 AS (
  SELECT u, v FROM (SELECT u, v, n / sum(n) OVER (PARTITION BY u) AS share, count(*) OVER (PARTITION BY u) AS m FROM g)
  WHERE m > 1 AND share < {CUTOFF}),
weak AS (SELECT u, v FROM weak0 UNION SELECT {_rc("v")}, {_rc("u")} FROM weak0)"""

MAPPED = f"""{SEQS}, {ITEMS},
idx AS (
  SELECT kmer, x.unitig_id AS unitig_id, x.strand AS strand, x.pos AS pos FROM (
    SELECT kmer, min({{'unitig_id': unitig_id, 'strand': strand, 'pos': pos}}) AS x FROM (
      {_kmers("(SELECT unitig_id, 'F' AS strand, seq FROM items UNION ALL SELECT unitig_id, 'R', " + _rc("seq") + " FROM items)", "unitig_id, strand", MAP_K)})
    GROUP BY kmer)),
hits AS (
  SELECT read_index, orientation, transcript, k.pos AS i, unitig_id, strand, idx.pos AS pos FROM (
    {_kmers("(SELECT read_index, transcript, 'FW' AS orientation, seq FROM seqs UNION ALL SELECT read_index, transcript, 'RC', " + _rc("seq") + " FROM seqs)", "read_index, transcript, orientation", MAP_K)}) k
  JOIN idx USING (kmer))"""
COLOURED = f"""{MAPPED},
cnt AS (SELECT unitig_id, count(*) FILTER (transcript) AS tr, count(*) FILTER (NOT transcript) AS sr
        FROM (SELECT DISTINCT unitig_id, read_index, orientation, transcript FROM hits) GROUP BY 1),
col AS (
  SELECT unitig_id, (coalesce(tr, 0) > 0 AND length(seq) >= {MAP_K + 5}) OR length(seq) >= {MAP_K + 15} AS trustable,
         coalesce(tr, 0) AS tr_count, coalesce(sr, 0) AS sr_count, seq FROM items LEFT JOIN cnt USING (unitig_id))"""
RUNS = """
f AS (
  SELECT *, CASE WHEN lag(unitig_id) OVER o = unitig_id AND lag(i) OVER o = i - 1 THEN 0 ELSE 1 END AS fresh
  FROM hits WINDOW o AS (PARTITION BY read_index, orientation ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY read_index, orientation ORDER BY i) AS run FROM f),
runs AS (
  SELECT read_index, orientation, CAST(run AS BIGINT) AS run, unitig_id, min(i) AS first_i, max(i) AS last_i, arg_min(strand, i) AS first_strand,
         arg_min(pos, i) AS first_pos, arg_max(strand, i) AS last_strand, arg_max(pos, i) AS last_pos FROM r GROUP BY ALL)"""
PAIRS = f"""{COLOURED}, {RUNS},
good AS (SELECT runs.*, length(seq) AS len FROM runs JOIN col USING (unitig_id) WHERE trustable),
pairs AS (
  SELECT a.read_index, a.orientation, a.unitig_id AS src, a.last_strand AS src_strand, a.last_i AS i, b.unitig_id AS dst, b.first_strand AS dst_strand,
         b.first_i AS j, row_number() OVER (PARTITION BY a.read_index, a.orientation, a.run ORDER BY b.run) AS rank
  FROM good a JOIN good b ON a.read_index = b.read_index AND a.orientation = b.orientation AND a.run < b.run AND a.unitig_id <> b.unitig_id
  WHERE a.last_pos = a.len - {MAP_K} AND b.first_pos = 0)"""
NEXT = f"{ITEMS}, nx AS (SELECT a.unitig_id AS a_id, b.unitig_id AS b_id, a.seq AS a, b.seq AS b FROM whole a JOIN whole b ON b.unitig_id = a.unitig_id + 1)"
SHARED = f"""{SEQS}, {ITEMS},
dk AS (SELECT DISTINCT read_index AS x, least(kmer, {_rc("kmer")}) AS kmer FROM ({_kmers("seqs", "read_index", K)})),
ik AS (SELECT DISTINCT unitig_id AS y, least(kmer, {_rc("kmer")}) AS kmer FROM ({_kmers("whole", "unitig_id", K)})),
sh AS (SELECT x, y, count(*) AS shared FROM dk JOIN ik USING (kmer) GROUP BY ALL)"""


def _semi(pairs: str) -> str:
    """Tables of the semi-global distance; ``pairs`` has (id, short, long), the result ``shortest`` (id, distance).

    A row of the table at a time; the running minimum settles insertions.
    """
    return f"""
strands AS (SELECT id, short, long FROM {pairs} UNION ALL SELECT id, short, {_rc("long")} FROM {pairs}),
dp AS (
  SELECT id, short, long, 0 AS i, list_transform(range(0, length(long) + 1), lambda j: CAST(0 AS BIGINT)) AS r FROM strands
  UNION ALL
  SELECT id, short, long, i + 1, list_transform(range(0, length(long) + 1), lambda j: j + list_min(t[1:j + 1])) FROM (
    SELECT id, short, long, i, list_transform(range(0, length(long) + 1), lambda j: CASE WHEN j = 0 THEN CAST(i + 1 AS BIGINT)
           ELSE least(r[j + 1] + 1, r[j] + CASE WHEN substr(long, CAST(j AS BIGINT), 1) = substr(short, i + 1, 1) THEN 0 ELSE 1 END) - j END) AS t
    FROM dp WHERE i < length(short))),
shortest AS (SELECT id, min(list_min(r)) AS distance FROM dp WHERE i = length(short) GROUP BY id)"""


def _doubled(name: str, start: str, rounds: int) -> str:
    """Tables name0 .. name<rounds>: pointers (node, ptr) of ``start`` with distance, least name and least code, doubled."""
    text = f"{name}0 AS MATERIALIZED ({start})"
    for i in range(rounds):
        a, b = f"{name}{i}", f"{name}{i + 1}"
        text += f""",
{b} AS MATERIALIZED (
  SELECT x.node, y.ptr, x.d + y.d AS d, least(x.name, y.name) AS name, least(x.low, y.low) AS low FROM {a} x JOIN {a} y ON x.ptr = y.node)"""
    return text


#: Pointer doublings in SQL: enough for unitigs of 2**17 k-mers.
_ROUNDS = 17
_SOLID = f"SELECT kmer, max(n) AS n FROM ({_counted('sr', LEAST)} UNION ALL {_counted('tr', 1)}) GROUP BY kmer"
# Tables from the nodes g1_o (kmer, n) and the arcs g2 (u, v) of a graph to its unitigs.
COMPACTED = f"""simple AS MATERIALIZED (
  SELECT u, v FROM g2 WHERE u IN (SELECT u FROM g2 GROUP BY u HAVING count(*) = 1) AND v IN (SELECT v FROM g2 GROUP BY v HAVING count(*) = 1)
  AND u <> v AND v <> {_rc("u")}),
{_doubled("p", f"SELECT kmer AS node, coalesce(u, kmer) AS ptr, CAST(u IS NOT NULL AS BIGINT) AS d, kmer AS name, least(kmer, {_rc('kmer')}) AS low FROM g1_o LEFT JOIN simple ON v = kmer", _ROUNDS)},
straight AS (SELECT x.node, x.ptr AS root, x.d FROM p{_ROUNDS} x JOIN p0 r ON x.ptr = r.node WHERE r.ptr = r.node),
ring AS MATERIALIZED (SELECT x.node, b.ptr AS prev, x.name, x.low FROM p{_ROUNDS} x JOIN p0 r ON x.ptr = r.node JOIN p0 b ON b.node = x.node WHERE r.ptr <> r.node),
held AS (SELECT name, bool_or(node = low) AS held FROM ring GROUP BY name),
{_doubled("q", f"SELECT node, CASE WHEN first THEN node ELSE prev END AS ptr, CAST(NOT first AS BIGINT) AS d, name, low FROM (SELECT ring.*, CASE WHEN held THEN node = low ELSE prev = {_rc('low')} END AS first FROM ring JOIN held USING (name))", _ROUNDS)},
chain AS (SELECT * FROM straight UNION ALL SELECT node, ptr, d FROM q{_ROUNDS}),
built AS (
  SELECT root, string_agg(CASE WHEN d = 0 THEN node ELSE right(node, 1) END, '' ORDER BY d) AS s, avg(n) AS coverage
  FROM chain JOIN g1_o ON node = kmer GROUP BY root),
unitig AS (SELECT least(s, {_rc("s")}) AS seq, max(coverage) AS coverage FROM built GROUP BY 1)"""
UNITIGS = f"""{SEQS}, {WEAK}, trk AS ({_counted("tr", 1)}), {_edges("t", "trk")},
fork AS (SELECT u AS kmer FROM t GROUP BY u HAVING count(*) > 1 UNION SELECT v FROM t GROUP BY v HAVING count(*) > 1),
gone AS (SELECT u, v FROM weak EXCEPT SELECT u, v FROM t WHERE u IN (SELECT kmer FROM fork) OR v IN (SELECT kmer FROM fork)),
merged AS MATERIALIZED ({_SOLID}), {_edges("g1", "merged")},
g2 AS MATERIALIZED (SELECT u, v FROM g1 WHERE (u, v) NOT IN (SELECT u, v FROM gone)),
{COMPACTED}"""


def _exon(name: str, first: str, last: str) -> str:
    digests = " || ".join(f"md5(concat_ws('/', CAST(item_id AS VARCHAR), '{name}{i}', coalesce(text, '')))" for i in range(3))
    return f"'{first}' || translate({digests}, '0123456789abcdef', '{'ACGT' * 4}') || '{last}' AS {name}"


_E = EVENT_K
_EXON = 98
PLANTED = f"""
ex AS (SELECT CAST(item_id AS BIGINT) AS item_id, (item_id % 4 + 4) % 4 AS kind, {_exon("a", "A", "G")}, {_exon("b", "A", "T")}, {_exon("c", "C", "A")} FROM benchmark WHERE item_id IS NOT NULL),
plant AS (SELECT *, CASE WHEN kind = 1 THEN a || c ELSE a || b || c END AS known FROM ex),
bub AS (
  SELECT item_id AS read_index, 'AS' AS label, CAST({_EXON - _E} AS INTEGER) AS source, CAST(CASE WHEN kind = 0 THEN {2 * _EXON} ELSE {_EXON} END AS INTEGER) AS target, known,
         right(a, {_E}) || CASE WHEN kind = 0 THEN b ELSE '' END || left(c, {_E}) AS orig_seq, right(a, {_E}) || CASE WHEN kind = 0 THEN '' ELSE b END || left(c, {_E}) AS alt_seq
  FROM plant WHERE kind < 2),
bubbles AS (
  SELECT *, CAST(3 AS INTEGER) AS n_nodes, CAST(2 AS INTEGER) AS n_branches, CAST(least(levenshtein(orig_seq, alt_seq), levenshtein({_rc("orig_seq")}, alt_seq)) AS INTEGER) AS edit_distance FROM bub),
classed AS (
  SELECT *, CASE WHEN edit_distance <= 1 THEN 'SNP' WHEN edit_distance / length(alt_seq) <= {EVENT_SHARE} THEN 'MSNPs'
            WHEN length(alt_seq) <= {2 * _E - 8} THEN 'REPEATS' ELSE 'AS' END AS event_type FROM bubbles)"""
# Unitigs of a planted item, along the transcript.
_ENDS_OF = {
    0: {"A": "a", "B": f"right(a, {_E - 1}) || b || left(c, {_E - 1})", "J": f"right(a, {_E - 1}) || left(c, {_E - 1})", "C": "c"},
    2: {
        "A": "a || left(b, 50)", "B": f"substr(known, {_EXON + 50 - _E + 2}, {2 * _E - 1})",
        "J": f"substr(a || left(b, 50) || translate(substr(b, 51, 1), 'ACGT', 'CGTA') || substr(b, 52) || c, {_EXON + 50 - _E + 2}, {2 * _E - 1})", "C": "substr(b, 52) || c",
    },
}
_STEPS = " UNION ALL ".join(
    f"SELECT {named[x]} AS x, {named[y]} AS y FROM plant WHERE kind {'< 2' if kind == 0 else '= 2'}" for kind, named in _ENDS_OF.items() for x, y in ("AB", "BC", "AJ", "JC")
)

_ENDS = "ed <= 1 THEN 'SNP' WHEN ed / length(b) <= 0.5 THEN 'MSNPs' WHEN length(b) <= 54 THEN 'REPEATS' ELSE 'AS' END"
_ED = f"least(levenshtein(a, b), levenshtein({_rc('a')}, b))"

ORACLE = {
    "kmer_count": f"WITH {SEQS} {_counted('sr', LEAST)}",
    "kmer_histogram": f"WITH {SEQS} SELECT n, count(*) AS kmers FROM ({_counted('seqs', 1)}) GROUP BY n",
    "sequence_scalars": f"""WITH {SEQS}, k AS ({_kmers("seqs", "read_index", K)}),
        m AS (SELECT read_index, list_min(list_transform(range(1, {K - 7 + 2}), lambda i: substr(kmer, i, 7))) AS m, kmer, least(kmer, {_rc("kmer")}) AS c FROM k),
        x AS (SELECT read_index, CAST(sum({_code("c", K)}) AS BIGINT) AS canonical, CAST(sum({_code("kmer", K)}) AS BIGINT) AS packed,
              CAST(sum({_code("m", 7)}) AS BIGINT) AS minimizer FROM m GROUP BY 1)
        SELECT read_index, md5(translate(seq, 'ACGT', 'TGCA')) AS complement, md5({_rc("seq")}) AS rc, seq <> '' AS acgt, canonical, packed, minimizer
        FROM seqs LEFT JOIN x USING (read_index)""",
    "graph_degrees": f"""WITH {SEQS}, merged AS (SELECT kmer, max(n) AS n FROM ({_counted("sr", LEAST)} UNION ALL {_counted("tr", 1)}) GROUP BY kmer), {_edges("g", "merged")},
        d AS (SELECT kmer, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT u AS kmer, 0 AS i, 1 AS o FROM g UNION ALL SELECT v, 1, 0 FROM g) GROUP BY kmer)
        SELECT CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, count(*) AS nodes FROM d GROUP BY ALL""",
    "weak_edges": f"WITH {SEQS}, {WEAK} SELECT * FROM weak",
    "rescued_removal": f"""WITH {SEQS}, {WEAK}, trk AS ({_counted("tr", 1)}), {_edges("t", "trk")},
        fork AS (SELECT u AS kmer FROM t GROUP BY u HAVING count(*) > 1 UNION SELECT v FROM t GROUP BY v HAVING count(*) > 1)
        SELECT u, v FROM weak EXCEPT SELECT u, v FROM t WHERE u IN (SELECT kmer FROM fork) OR v IN (SELECT kmer FROM fork)""",
    "unitig_edges": f"""WITH {ITEMS},
        e0 AS (SELECT unitig_id, 'L' AS side, substr(seq, 1, 6) AS s FROM items WHERE length(seq) >= 8 UNION ALL SELECT unitig_id, 'R', right(seq, 6) FROM items WHERE length(seq) >= 8),
        e AS (SELECT unitig_id, side, least(s, {_rc("s")}) AS key, s <= {_rc("s")} AS plain FROM e0)
        SELECT DISTINCT a.unitig_id AS src, b.unitig_id AS dst,
               CASE WHEN a.side = 'L' AND b.side = 'L' THEN 'RF' WHEN a.side = 'L' THEN 'RR' WHEN b.side = 'L' THEN 'FF' ELSE 'FR' END AS label
        FROM e a JOIN e b ON a.key = b.key AND a.unitig_id <> b.unitig_id WHERE (a.side = b.side) = (a.plain <> b.plain)""",
    "kmer_index": f"WITH {MAPPED} SELECT kmer, unitig_id, strand, pos FROM idx",
    "read_hits": f"WITH {MAPPED} SELECT read_index, orientation, count(*) AS hits, count(DISTINCT unitig_id) AS unitigs FROM hits GROUP BY ALL",
    "coloured_unitigs": f"WITH {COLOURED} SELECT * FROM col",
    "unitig_transcripts": f"WITH {MAPPED} SELECT DISTINCT unitig_id, read_index FROM hits WHERE transcript",
    "transcript_quantification": f"""WITH {COLOURED} SELECT read_index, round(avg(sr_count), 6) AS sr_mean
        FROM (SELECT DISTINCT read_index, unitig_id, strand FROM hits WHERE transcript) JOIN col USING (unitig_id) GROUP BY read_index""",
    "mapping_runs": f"WITH {MAPPED}, {RUNS} SELECT * FROM runs",
    "linking_edges": f"""WITH {PAIRS}, l AS (
        SELECT src, src_strand, dst, dst_strand, substr(CASE WHEN orientation = 'FW' THEN seq ELSE {_rc("seq")} END, i + {MAP_K} + 1, greatest(j - i - 1, 0)) AS label, count(*) AS n
        FROM pairs JOIN seqs USING (read_index) WHERE rank = 1 GROUP BY ALL)
        SELECT src, src_strand, dst, dst_strand, md5(label) AS label, n, length(label) AS label_length FROM l
        QUALIFY row_number() OVER (PARTITION BY src, src_strand, dst, dst_strand ORDER BY n DESC, label) = 1""",
    "linking_hints": f"WITH {PAIRS} SELECT DISTINCT src, src_strand, dst, dst_strand FROM pairs",
    "mate_hints": f"""WITH {COLOURED}, vx AS (SELECT DISTINCT read_index, orientation, unitig_id, strand FROM hits JOIN col USING (unitig_id) WHERE trustable)
        SELECT DISTINCT a.unitig_id AS src, a.strand AS src_strand, b.unitig_id AS dst, b.strand AS dst_strand FROM vx a JOIN vx b
        ON a.orientation = 'FW' AND b.orientation = 'RC' AND a.read_index <> b.read_index AND a.read_index // 2 = b.read_index // 2""",
    "event_classes": f"""WITH {NEXT}, e AS (SELECT *, {_ED} AS ed FROM nx)
        SELECT a_id, b_id, CAST(ed AS INTEGER) AS ed, CASE WHEN {_ENDS} AS type, ed / greatest(length(a), length(b)) < 0.6 AS similar FROM e""",
    "anchored_distances": f"""WITH {NEXT},
        st AS (SELECT a_id, b_id, 'F' AS s, a, b FROM nx UNION ALL SELECT a_id, b_id, 'R', {_rc("a")}, b FROM nx),
        win AS (
          SELECT a_id, s, i, levenshtein(substr(a, i, {ANCHOR_K - 1}), left(b, {ANCHOR_K - 1})) AS l, levenshtein(substr(a, i, {ANCHOR_K - 1}), right(b, {ANCHOR_K - 1})) AS r
          FROM (SELECT *, unnest(range(1, length(a) - {ANCHOR_K - 1} + 1)) AS i FROM st WHERE length(a) >= {ANCHOR_K} AND length(b) >= {ANCHOR_K - 1})),
        bl AS (SELECT a_id, s, i FROM win QUALIFY l = min(l) OVER (PARTITION BY a_id, s)), br AS (SELECT a_id, s, i FROM win QUALIFY r = min(r) OVER (PARTITION BY a_id, s)),
        ds AS (
          SELECT a_id, min(levenshtein(substr(a, bl.i, br.i + {ANCHOR_K - 1} - bl.i), b)) AS d FROM st JOIN bl USING (a_id, s) JOIN br USING (a_id, s)
          WHERE br.i + {ANCHOR_K - 1} > bl.i GROUP BY a_id)
        SELECT a_id, b_id, CAST(d AS INTEGER) AS distance FROM nx LEFT JOIN ds USING (a_id)""",
    "best_anchors": f"""WITH {NEXT}, w AS (
        SELECT a_id, b_id, i - 1 AS pos, levenshtein(substr(a, i, 12), substr(b, 1, 12)) AS ed
        FROM (SELECT *, unnest(range(1, length(a) - 11)) AS i FROM nx WHERE length(a) > 12 AND length(b) >= 12))
        SELECT a_id, b_id, CAST(ed AS INTEGER) AS ed, CAST(pos AS INTEGER) AS pos FROM w QUALIFY ed = min(ed) OVER (PARTITION BY a_id, b_id)""",
    "simulated_reads": f"""WITH {SEQS}, c AS (SELECT read_index, start, substr(seq, start + 1, 101) AS s
        FROM (SELECT read_index, seq, unnest(range(0, length(seq) - 101, 30)) AS start FROM seqs))
        SELECT read_index, CAST(start AS INTEGER) AS start, CASE WHEN substr(md5(read_index || '/' || start), 1, 1) >= '8' THEN {_rc("s")} ELSE s END AS seq FROM c""",
    "shallow_sample": """SELECT doc_id, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.1))""",
    "splice_chains": """WITH s AS (
        SELECT l_orderkey, l_linenumber AS n, l_partkey || CASE l_returnflag WHEN 'A' THEN '-' ELSE '^' END AS it, l_partkey || ':' || CASE l_returnflag WHEN 'A' THEN 'start' ELSE 'end' END AS f,
               l_partkey || ':' || CASE l_returnflag WHEN 'A' THEN 'end' ELSE 'start' END AS r FROM lineitem WHERE l_returnflag IN ('A', 'N'))
        SELECT o.l_orderkey, coalesce(sites, '') AS sites, coalesce(minus, '') AS minus FROM (SELECT DISTINCT l_orderkey FROM lineitem) o
        LEFT JOIN (SELECT l_orderkey, string_agg(f, ',' ORDER BY n, it) AS sites, string_agg(r, ',' ORDER BY n DESC, it DESC) AS minus FROM s GROUP BY 1) USING (l_orderkey)""",
    "spliced_exons": f"""WITH {SEQS}, e AS (SELECT read_index, seq, unnest(list_sort([
          {{'s': greatest(length(seq) - 49, 1), 'e': length(seq)}}, {{'s': 1, 'e': least(length(seq), 60)}}, {{'s': length(seq) // 2 + 1, 'e': length(seq) // 2 + 33}}])) AS x,
          unnest([1, 2, 3]) AS n FROM seqs)
        SELECT read_index, string_agg(substr(seq, x.s, greatest(x.e - x.s + 1, 0)), '' ORDER BY n) AS spliced FROM e GROUP BY read_index""",
    "overlapping_intervals": """WITH s AS (SELECT doc_id AS id, doc_id * 100 AS a, doc_id * 100 + n_chars % 400 AS b FROM documents)
        SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.id < y.id AND x.a <= y.b AND y.a <= x.b""",
    "event_runs": """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER o = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
        SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM r GROUP BY ALL""",
    "shared_kmers": f"WITH {SHARED} SELECT * FROM sh WHERE shared >= 10",
    "distinct_pairs": f"""WITH {NEXT}, p AS (SELECT a, b FROM nx UNION ALL SELECT {_rc("b")}, {_rc("a")} FROM nx)
        SELECT count(DISTINCT least(a || '/' || b, b || '/' || a, {_rc("a")} || '/' || {_rc("b")}, {_rc("b")} || '/' || {_rc("a")})) AS pairs FROM p""",
    "match_triage": f"""WITH {SHARED}, c AS (
        SELECT read_index, CASE WHEN EXISTS (SELECT 1 FROM sh JOIN whole ON y = unitig_id WHERE x = read_index AND contains(seqs.seq, whole.seq)) THEN 'matched'
        WHEN EXISTS (SELECT 1 FROM sh WHERE x = read_index AND shared >= 10) THEN 'same_gene'
        WHEN EXISTS (SELECT 1 FROM sh WHERE x = read_index) THEN 'chimeric' ELSE 'unexplained' END AS class FROM seqs)
        SELECT class, count(*) AS documents FROM c GROUP BY class""",
    "unitig_table": f"WITH {UNITIGS} SELECT row_number() OVER (ORDER BY seq) - 1 AS unitig_id, seq, CAST(length(seq) AS INTEGER) AS len, coverage FROM unitig",
    "semi_global": f"""WITH RECURSIVE {NEXT},
        pr AS (SELECT a_id AS id, b_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM nx), {_semi("pr")},
        cell AS (SELECT a_id, i - j AS diagonal, i, CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN 2 ELSE -1 END AS v
                 FROM (SELECT a_id, a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT a_id, a, b, unnest(range(1, length(a) + 1)) AS i FROM nx))),
        run AS (SELECT a_id, diagonal, i, sum(v) OVER (PARTITION BY a_id, diagonal ORDER BY i) AS s FROM cell),
        best AS (SELECT a_id, max(score) AS score FROM (
          SELECT a_id, s - least(0, coalesce(min(s) OVER (PARTITION BY a_id, diagonal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM run) GROUP BY a_id)
        SELECT pr.id AS a_id, b_id, distance, CAST(greatest(score, 0) AS BIGINT) AS score FROM pr JOIN shortest USING (id) JOIN best ON best.a_id = pr.id""",
    "reachable_unitigs": f"""WITH RECURSIVE {PAIRS},
        arc AS (SELECT DISTINCT src || '_' || src_strand AS src, dst || '_' || dst_strand AS dst, CAST(greatest(length(seq) - {MAP_K} + 1, 1) AS BIGINT) AS w FROM pairs JOIN col ON dst = unitig_id WHERE rank = 1),
        walk AS (
          SELECT DISTINCT read_index AS "group", unitig_id || '_' || strand AS node, CAST(0 AS BIGINT) AS dist FROM hits WHERE transcript AND orientation = 'FW'
          UNION SELECT "group", arc.dst, dist + w FROM walk JOIN arc ON node = arc.src WHERE dist + w <= 400)
        SELECT "group", node, min(dist) AS dist FROM walk GROUP BY ALL""",
    "novel_bubbles": f"WITH {PLANTED} SELECT * EXCLUDE (known) FROM classed",
    "bubble_records": f"""WITH RECURSIVE {PLANTED}, pr AS (SELECT read_index AS id, alt_seq AS short, known AS long FROM classed), {_semi("pr")},
        kinds AS (SELECT *, unnest(['blat', 'blat.clustered']) AS kind FROM classed JOIN shortest ON id = read_index)
        SELECT kind, event_type, read_index, CAST(0 AS BIGINT) AS place, 't' || read_index AS header, known AS seq FROM kinds
        UNION ALL SELECT kind, event_type, read_index, 1, 'Length=' || length(alt_seq) || ';Novel_AS_sequence', alt_seq FROM kinds
        WHERE kind = 'blat' OR distance / least(length(alt_seq), length(known)) >= 0.2""",
    "transcript_paths": f"""WITH {PLANTED} SELECT item_id AS read_index, true AS same, CASE WHEN kind = 3 THEN 8.0 ELSE 10.0 END::DOUBLE AS sr_mean,
        CAST(CASE WHEN kind = 3 THEN 1 ELSE 3 END AS INTEGER) AS nodes, CAST(length(known) - {_E} + 1 AS BIGINT) AS kmers FROM plant""",
    "link_counters": f"""WITH {COLOURED}, {RUNS},
        good AS (SELECT runs.*, length(seq) AS len FROM runs JOIN col USING (unitig_id) WHERE trustable),
        st AS (SELECT good.*, last_pos = len - {MAP_K} AS whole FROM good JOIN seqs USING (read_index) WHERE last_i < length(seqs.seq) - {MAP_K}),
        pr AS (SELECT a.read_index, a.orientation, a.run, b.run AS stop, a.unitig_id <> b.unitig_id AS different, b.first_pos = 0 AS entered
               FROM st a JOIN good b ON a.whole AND a.read_index = b.read_index AND a.orientation = b.orientation AND a.run < b.run),
        pl AS (SELECT *, coalesce(bool_or(different AND entered) OVER (PARTITION BY read_index, orientation, run ORDER BY stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS linked FROM pr),
        hc AS (SELECT count(*) AS mapped, count(*) FILTER (trustable) AS good FROM hits JOIN col USING (unitig_id)),
        kc AS (SELECT CAST(sum(2 * greatest(length(seq) - {MAP_K - 1}, 0)) AS BIGINT) AS kmers FROM seqs)
        SELECT 'kmers_mapped' AS metric, mapped AS value FROM hc UNION ALL SELECT 'kmers_not_mapped', kmers - mapped FROM hc, kc
        UNION ALL SELECT 'kmers_on_trustable', good FROM hc UNION ALL SELECT 'kmers_on_others', mapped - good FROM hc
        UNION ALL SELECT 'not_linked_start_not_left', count(*) FROM st WHERE NOT whole UNION ALL SELECT 'not_linked_equal_unitig', count(*) FROM pl WHERE NOT different
        UNION ALL SELECT 'not_linked_end_not_entered', count(*) FROM pl WHERE different AND NOT entered AND NOT linked
        UNION ALL SELECT 'not_hinted_end_not_entered', count(*) FROM pl WHERE different AND NOT entered AND linked
        UNION ALL SELECT 'linked', count(*) FROM pl WHERE different AND entered AND NOT linked UNION ALL SELECT 'hinted', count(*) FROM pl WHERE different AND entered""",
    "surviving_edges": f"""WITH {PLANTED}, st AS ({_STEPS}),
        o AS (SELECT least(x, {_rc("x")}) AS cx, least(y, {_rc("y")}) AS cy, CASE WHEN x <= {_rc("x")} THEN 'F' ELSE 'R' END AS sx, CASE WHEN y <= {_rc("y")} THEN 'F' ELSE 'R' END AS sy FROM st)
        SELECT md5(cx) AS src_seq, md5(cy) AS dst_seq, sx || sy AS label FROM o UNION ALL SELECT md5(cy), md5(cx), translate(sy || sx, 'FR', 'RF') FROM o""",
}
