"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

# Derived reads: rid numbers them, k is the CIGAR shape, a length up to 0 is added to that of the read.
READS = """
r AS (
  SELECT row_number() OVER () AS rid,
    (((l_orderkey * 8 + l_linenumber) * 1024 + l_partkey % 1024) * 256 + l_suppkey % 256) * 64 + CAST(floor(l_quantity) AS BIGINT) AS read_id,
    CAST(l_orderkey AS VARCHAR) AS qname, concat('chr', CAST(l_suppkey % 3 + 1 AS VARCHAR)) AS contig,
    (l_partkey * 37 + l_orderkey * 11) % 9000 AS pos, CAST((l_orderkey + l_linenumber) % 16 AS INTEGER) AS k,
    CAST(l_orderkey % 61 AS INTEGER) AS mapq, CAST(20 + floor(l_quantity) AS INTEGER) AS qlen, l_partkey % 29 = 0 AS no_quality,
    CAST(1 + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END
      + CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 17 = 0 THEN 256 ELSE 0 END
      + CASE WHEN l_partkey % 19 = 0 THEN 2048 ELSE 0 END + CASE WHEN l_suppkey % 23 = 0 THEN 512 ELSE 0 END
      + CASE WHEN l_partkey % 5 = 0 THEN 32 ELSE 0 END + CASE WHEN (l_orderkey + l_linenumber) % 16 = 14 THEN 4 ELSE 0 END AS INTEGER) AS flag
  FROM lineitem
), shapes(k, i, op, n) AS (
  VALUES (0, 0, 'M', 0), (1, 0, 'M', 10), (1, 1, 'D', 2), (1, 2, 'M', -10), (2, 0, 'M', 10), (2, 1, 'I', 3), (2, 2, 'M', -13),
    (3, 0, 'M', 10), (3, 1, 'N', 50), (3, 2, 'M', -10), (4, 0, 'S', 5), (4, 1, 'M', -5),
    (5, 0, 'H', 3), (5, 1, 'S', 4), (5, 2, 'M', -6), (5, 3, 'S', 2), (5, 4, 'H', 5), (6, 0, '=', 8), (6, 1, 'X', 1), (6, 2, '=', -9),
    (7, 0, 'M', 10), (7, 1, 'D', 2), (7, 2, 'I', 2), (7, 3, 'M', -12), (8, 0, 'M', 10), (8, 1, 'I', 2), (8, 2, 'D', 2), (8, 3, 'M', -12),
    (9, 0, 'M', 10), (9, 1, 'P', 1), (9, 2, 'I', 2), (9, 3, 'P', 1), (9, 4, 'I', 1), (9, 5, 'M', -13),
    (10, 0, 'M', 10), (10, 1, 'N', 30), (10, 2, 'I', 1), (10, 3, 'M', -11), (11, 0, 'M', -4), (11, 1, 'D', 2), (11, 2, 'S', 4),
    (12, 0, 'D', 2), (12, 1, 'M', 0), (12, 2, 'D', 3), (13, 0, '=', 6), (13, 1, 'X', 2), (13, 2, 'I', 1), (13, 3, 'M', -12), (13, 4, 'S', 3), (15, 0, 'M', 0)
), opened AS (
  SELECT rid, i, op, CAST(CASE WHEN n > 0 THEN n ELSE qlen + n END AS INTEGER) AS len FROM r JOIN shapes USING (k)
), totals AS (
  SELECT rid, CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) AS INTEGER) AS ref_len,
    CAST(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) AS INTEGER) AS query_len,
    CAST(sum(CASE WHEN op = 'M' THEN len ELSE 0 END) AS INTEGER) AS matching, CAST(sum(CASE WHEN op IN ('I', 'D') THEN len ELSE 0 END) AS INTEGER) AS indels,
    string_agg(concat(len, op), '' ORDER BY i) AS cigar
  FROM opened GROUP BY rid
), reads AS (
  SELECT r.*, coalesce(ref_len, 0) AS ref_len, coalesce(query_len, 0) AS query_len, coalesce(matching, 0) AS matching, coalesce(indels, 0) AS indels,
    coalesce(cigar, '*') AS cigar, pos + greatest(coalesce(ref_len, 0) - 1, 0) AS end_pos
  FROM r LEFT JOIN totals USING (rid)
)"""

# Ops with their places on reference and query; c numbers runs of I and P with the op before them, whose I count as inserted after it.
OPS = (
    READS
    + """, numbered AS (
  SELECT *, sum(CASE WHEN op IN ('I', 'P') THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS c FROM opened
), ops AS (
  SELECT r.*, o.i, o.op, o.len,
    CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS BIGINT) AS rs,
    CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS INTEGER) AS qs,
    CAST(coalesce(sum(CASE WHEN op = 'I' THEN len ELSE 0 END) OVER (PARTITION BY rid, c ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS INTEGER) AS ins
  FROM numbered o JOIN reads r USING (rid)
  WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
)

COLS = (
    OPS
    + """, cols AS (
  SELECT o.* EXCLUDE (pos), o.pos AS read_pos, rs + j AS pos, j, CASE WHEN op IN ('M', '=', 'X') THEN qs + j END AS qpos,
    CASE WHEN j = len - 1 THEN ins ELSE 0 END AS insert_len
  FROM ops o, unnest(range(len)) AS t(j) WHERE op IN ('M', 'D', 'N', '=', 'X') AND flag & 4 = 0
)"""
)

REF = "substr('ACGT', CAST(({0} * 7 + {0} // 3) % 4 + 1 AS INTEGER), 1)"
REFBASE = REF.format("pos")
# The base of a query position q that lies at w: X always differs from the reference, = never, of M one in 11; some M are N.
BASE = """CASE WHEN op = 'M' AND (read_id + {q}) % 97 = 0 THEN 'N' ELSE substr('ACGT', CAST(({w} * 7 + {w} // 3
  + CASE WHEN op = 'X' THEN 1 WHEN op = '=' THEN 0 WHEN (read_id + {q}) % 11 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INTEGER), 1) END"""
QUAL = "CAST(CASE WHEN no_quality THEN 255 ELSE (read_id * 7 + {q} * 3) % 42 END AS INTEGER)"

BASED = (
    COLS
    + f""", based AS (
  SELECT *, {REFBASE} AS ref_base,
    CASE WHEN qpos IS NULL THEN NULL WHEN k = 15 THEN 'N' ELSE {BASE.format(q="qpos", w="pos")} END AS base,
    CASE WHEN qpos IS NULL THEN NULL WHEN k = 15 THEN 255 ELSE {QUAL.format(q="qpos")} END AS qual
  FROM cols
), usable AS (SELECT * FROM based WHERE mapq >= 20 AND flag & 3844 = 0)"""
)

COUNTS = (
    BASED
    + """, counts AS (
  SELECT contig, pos, count(*) FILTER (WHERE base = 'A') AS n_a, count(*) FILTER (WHERE base = 'C') AS n_c,
    count(*) FILTER (WHERE base = 'G') AS n_g, count(*) FILTER (WHERE base = 'T') AS n_t, count(qpos) AS match_depth,
    any_value(ref_base) AS ref_base
  FROM usable GROUP BY contig, pos
), alts AS (
  SELECT *, greatest(CASE WHEN ref_base = 'A' THEN 0 ELSE n_a END, CASE WHEN ref_base = 'C' THEN 0 ELSE n_c END,
    CASE WHEN ref_base = 'G' THEN 0 ELSE n_g END, CASE WHEN ref_base = 'T' THEN 0 ELSE n_t END) AS top
  FROM counts
), best AS (
  SELECT *, CASE WHEN top = 0 THEN NULL WHEN ref_base <> 'A' AND n_a = top THEN 'A' WHEN ref_base <> 'C' AND n_c = top THEN 'C'
    WHEN ref_base <> 'G' AND n_g = top THEN 'G' ELSE 'T' END AS alt
  FROM alts
), called AS (
  SELECT contig, pos, ref_base, alt, n_a + n_c + n_g + n_t AS depth, top AS alt_count, top / (n_a + n_c + n_g + n_t) AS af,
    CASE WHEN top / (n_a + n_c + n_g + n_t) >= 0.8 THEN '1/1' ELSE '0/1' END AS gt
  FROM best WHERE alt IS NOT NULL AND n_a + n_c + n_g + n_t >= 5 AND top / (n_a + n_c + n_g + n_t) >= 0.1
)"""
)

# Bases of whole reads; unmapped ones lie as if they were aligned without gaps.
QUERY = (
    OPS
    + f""", parts AS (
  SELECT read_id, rid, contig, flag, mapq, pos, qlen, k, no_quality, i, op, len, rs, qs FROM ops WHERE op IN ('M', 'I', 'S', '=', 'X') AND k <> 15
  UNION ALL SELECT read_id, rid, contig, flag, mapq, pos, qlen, k, no_quality, 0, 'M', qlen, pos, 0 FROM reads WHERE k = 14
), letters AS (
  SELECT *, {BASE.format(q="qpos", w="w")} AS base, {QUAL.format(q="qpos")} AS qual
  FROM (SELECT *, rs + j AS w, qs + j AS qpos FROM parts, unnest(range(len)) AS t(j))
), texts AS (
  SELECT rid, string_agg(base, '' ORDER BY qpos) AS seq, CAST(sum(qual) AS INTEGER) AS quality FROM letters GROUP BY rid
)"""
)

# Entries of modifications by the read's kind: base, code, number of the base in read direction, which probability.
MODS = (
    QUERY
    + """, entries(v, base, code, nth, p) AS (
  VALUES (0, 'C', 'm', 1, 0), (0, 'C', 'm', 3, 1), (1, 'C', 'm', 1, 0), (1, 'C', 'm', 3, 1), (2, 'C', 'm', 1, 0), (2, 'C', 'm', 3, 1),
    (3, 'C', 'm', 2, 0), (3, 'C', 'h', 2, 1), (4, 'C', 'C', 1, 0), (5, 'C', 'h', 1, 0), (5, 'A', 'a', 1, 1)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid, base ORDER BY CASE WHEN flag & 16 <> 0 THEN -qpos ELSE qpos END) AS nth,
    CASE WHEN flag & 16 <> 0 THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS own
  FROM letters
), found AS (
  SELECT ranked.*, code, CASE WHEN p = 0 THEN read_id % 256 ELSE read_id * 3 % 256 END AS prob
  FROM ranked JOIN entries e ON e.v = read_id % 8 AND e.base = own AND e.nth = ranked.nth
)"""
)

# Sequences of reads, as a subquery of its own.
TEXTS = f"""SELECT rid, string_agg(base, '' ORDER BY qpos) AS seq FROM (
  SELECT rid, qs + q AS qpos, {BASE.format(q="(qs + q)", w="(rs + q)")} AS base FROM ops, unnest(range(len)) AS u(q) WHERE op IN ('M', 'I', 'S', '=', 'X') AND k <> 15) GROUP BY rid"""

# Six significant digits: %.{p}e rounds correctly; the digits are then moved by the exponent.
SIX = """CASE WHEN {0} = 0 THEN '0' WHEN abs({0}) >= 1e6 THEN printf('%.0f', CAST({0} AS DOUBLE)) ELSE
  regexp_replace(regexp_replace(CAST(CAST(printf('%.5e', CAST({0} AS DOUBLE)) AS DECIMAL(38, 30)) AS VARCHAR), '0+$', ''), '\\.$', '') END"""

# Steps of template lengths after READS, and their last.
TLEN = """m AS (SELECT *, pos + ref_len AS z FROM reads WHERE flag & 4 = 0),
      t AS (SELECT qname, contig, min(pos) AS low, max(z) AS high, count(*) AS n, min(read_id) AS first_id FROM m GROUP BY qname, contig),
      c AS (SELECT t.*, count(*) FILTER (WHERE m.pos = low) AS lefts, count(*) FILTER (WHERE m.z = high) AS rights,
        any_value(m.pos) FILTER (WHERE read_id = first_id) AS f_pos, any_value(m.z) FILTER (WHERE read_id = first_id) AS f_end,
        any_value(m.flag) FILTER (WHERE read_id = first_id) AS f_flag FROM t JOIN m USING (qname, contig) WHERE n > 1 AND high > low GROUP BY ALL),
      s AS (SELECT *, CASE WHEN f_pos = low AND (f_end < high OR lefts <= 1) THEN 1
        WHEN f_pos = low AND f_end = high AND lefts > 1 AND rights > 1 THEN CASE WHEN f_flag & 64 <> 0 THEN 1 ELSE -1 END ELSE -1 END AS sign FROM c)"""
TLEN_LAST = """SELECT read_id, CAST(CASE WHEN flag & 4 <> 0 OR sign IS NULL THEN 0 WHEN read_id = first_id THEN sign * (high - low) ELSE -sign * (high - low) END AS BIGINT) AS tlen
      FROM reads LEFT JOIN s USING (qname, contig)"""

# What comes back of a file with all reads.
BACK = f"""WITH {QUERY}, {TLEN}, l AS ({TLEN_LAST})

SELECT qname, flag, contig, pos, mapq, cigar, CASE WHEN mapq % 2 = 0 THEN pos + 7 ELSE -1 END AS next_pos, CAST(tlen AS INTEGER) AS tlen, coalesce(seq, '') AS seq, coalesce(quality, 0) AS quality,
        read_id % 100000 AS xi, 'one' AS rg, read_id % 8 / 2 AS xf, CAST(read_id % 1000 AS DOUBLE) AS xb
      FROM reads LEFT JOIN texts USING (rid) JOIN l USING (read_id)"""

SQL: dict[str, str] = {
    "region_fetch": f"WITH {READS} SELECT read_id, contig, pos, end_pos, mapq FROM reads WHERE contig = 'chr1' AND flag & 4 = 0 AND pos <= 2000 AND end_pos >= 1000",
    "fetch_counts": f"""WITH {READS} SELECT count(*) AS fetched, count(*) FILTER (WHERE mapq >= 20 AND flag & 3844 = 0) AS kept
      FROM reads WHERE contig = 'chr1' AND pos <= 2000 AND end_pos >= 1000""",
    "customized_records": f"WITH {READS} SELECT read_id, CAST(matching - indels AS BIGINT) AS extra FROM reads WHERE mapq >= 30 AND matching - indels > 40",
    "flag_predicates": f"""WITH {READS} SELECT contig, {", ".join(f"count(*) FILTER (WHERE flag & {b} <> 0) AS {n}" for n, b in (
        ("paired", 1), ("proper_pair", 2), ("unmapped", 4), ("mate_unmapped", 8), ("reverse", 16), ("mate_reverse", 32),
        ("first_in_template", 64), ("second_in_template", 128), ("secondary", 256), ("qc_fail", 512), ("duplicate", 1024), ("supplementary", 2048)))}
      FROM reads GROUP BY contig""",
    "flag_edits": f"WITH {READS} SELECT read_id, flag | 256 AS set_secondary, flag & 4078 AS cleared FROM reads",
    "strand_labels": f"""WITH {READS}, s AS (SELECT CASE WHEN flag & 64 <> 0 THEN CASE WHEN flag & 16 <> 0 THEN 'OB' ELSE 'OT' END
        WHEN flag & 32 <> 0 THEN 'OB' ELSE 'OT' END AS label FROM reads)
      SELECT label, CASE label WHEN 'OT' THEN '+' ELSE '-' END AS symbol, count(*) AS n FROM s GROUP BY label""",
    "phred_convert": """SELECT CAST(CASE WHEN l_discount = 0 THEN 99 WHEN -10 * log10(l_discount) <= 0 THEN 0 WHEN -10 * log10(l_discount) >= 99 THEN 99
        ELSE round(-10 * log10(l_discount)) END AS INTEGER) AS phred, count(*) AS n, round(min(1 - l_discount), 6) AS least_inverted
      FROM lineitem GROUP BY 1""",
    "quality_values": "SELECT p_partkey, CAST(coalesce(nullif(p_partkey % 256, 255), -1) AS INTEGER) AS quality FROM part",
    "rms_mapq": f"WITH {READS} SELECT contig, round(sqrt(avg(mapq * mapq)), 6) AS rms FROM reads GROUP BY contig",
    "reverse_complement": """WITH s AS (SELECT p_partkey, regexp_replace(upper(replace(p_name, ' ', '')), '[^ACGT]', 'N', 'g') AS seq FROM part)
      SELECT p_partkey, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM s""",
    "base_indexes": """WITH s AS (SELECT p_partkey, substr(regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g'), 1, 1) AS base FROM part)
      SELECT p_partkey, base, CAST(instr('ACGT', base) - 1 AS INTEGER) AS idx FROM s""",
    "dedup_records": f"""WITH {READS}, two AS (SELECT contig, pos, flag, qname, read_id * 2 + c AS read_id FROM reads, unnest([0, 1]) AS t(c)),
      l AS (SELECT *, lag(flag) OVER w AS f, lag(qname) OVER w AS q FROM two WINDOW w AS (PARTITION BY contig, pos ORDER BY read_id, flag))
      SELECT contig, count(*) AS n, CAST(sum(read_id % 1000003) AS BIGINT) AS ids FROM l WHERE NOT coalesce(f = flag AND q = qname, false) GROUP BY contig""",
    "sorted_records": f"WITH {READS} SELECT read_id, contig, pos FROM reads ORDER BY contig, pos, read_id",
    "tlen_mates": f"WITH {READS}, {TLEN} {TLEN_LAST}",
    "mate_join": f"""WITH {READS}, p AS (SELECT * FROM reads WHERE flag & 2304 = 0),
      s AS (SELECT qname, min(read_id) FILTER (WHERE flag & 64 <> 0) AS first_id, min(read_id) FILTER (WHERE flag & 128 <> 0) AS second_id FROM p GROUP BY qname)
      SELECT s.qname, first_id, second_id, a.contig AS first_contig, b.contig AS second_contig, CASE WHEN a.contig = b.contig THEN b.pos - a.pos END AS distance
      FROM s JOIN reads a ON a.read_id = first_id JOIN reads b ON b.read_id = second_id""",
    "realign_clip": f"""WITH {OPS}, f AS (SELECT rid, op = 'M' AND len > 12 AS moves FROM ops WHERE i = 0),
      c AS (SELECT rid, string_agg(CASE WHEN i = 0 AND moves THEN concat('12S', len - 12, 'M') ELSE concat(len, op) END, '' ORDER BY i) AS cigar FROM ops JOIN f USING (rid) GROUP BY rid)
      SELECT read_id, CASE WHEN moves THEN pos + 12 ELSE pos END AS pos, coalesce(c.cigar, '*') AS cigar FROM reads LEFT JOIN f USING (rid) LEFT JOIN c USING (rid)""",
    "cigar_stats": f"""WITH {READS} SELECT read_id, query_len, ref_len, matching, indels, end_pos, CAST(pos + ref_len AS BIGINT) AS exclusive_end,
      k IN (0, 4, 5, 6, 15) AS linear FROM reads""",
    "cigar_round_trip": f"""WITH {READS}, c AS (SELECT rid, string_agg(CAST(len * 16 + instr('MIDNSHP=X', op) - 1 AS VARCHAR), ',' ORDER BY i) AS codes FROM opened GROUP BY rid)
      SELECT read_id, cigar, coalesce(codes, '') AS codes, true AS same FROM reads LEFT JOIN c USING (rid)""",
    "trailing_trim": f"""WITH {READS}, t AS (SELECT rid, read_id % 3 AS m, k, concat(CASE WHEN cigar = '*' THEN '' ELSE cigar END) AS own FROM reads),
      bare AS (SELECT *, CASE WHEN k = 12 THEN regexp_replace(own, '3D$', '') ELSE own END AS short FROM t)
      SELECT read_id, CASE WHEN m = 0 AND short = '' THEN '*' WHEN m = 0 THEN short WHEN m = 1 THEN concat(own, '4D3S') ELSE concat(own, '1M') END AS cigar FROM reads JOIN bare USING (rid)""",
    "position_lookup": f"""WITH {OPS}, hit AS (SELECT rid, op, rs, qs FROM ops WHERE op IN ('M', 'D', 'N', '=', 'X') AND rs <= pos + 15 AND pos + 15 < rs + len)
      SELECT read_id, op, CAST(CASE WHEN op IN ('M', '=', 'X') THEN qs + pos + 15 - rs ELSE -1 END AS INTEGER) AS qpos FROM reads LEFT JOIN hit USING (rid)""",
    "pileup_depth": f"""WITH {COLS} SELECT contig, pos, count(*) AS depth, {REFBASE} AS ref_base
      FROM cols WHERE contig = 'chr1' AND pos BETWEEN 1000 AND 2000 AND mapq >= 20 GROUP BY contig, pos""",
    "pileup_ops": f"""WITH {COLS} SELECT contig, pos, count(*) AS depth, count(qpos) AS match_depth, count(*) FILTER (WHERE qpos IS NULL AND (op = 'D' OR insert_len > 0)) AS deletions,
      count(*) FILTER (WHERE op = 'N') AS refskips, CAST(sum(insert_len) AS BIGINT) AS inserted FROM cols GROUP BY contig, pos""",
    "pileup_kinds": f"""WITH {COLS} SELECT contig, CASE WHEN qpos IS NULL THEN CASE WHEN insert_len > 0 THEN 'complex' WHEN op = 'D' THEN 'del' ELSE 'skip' END
        ELSE CASE WHEN insert_len > 0 THEN 'insertion' ELSE 'match' END END AS kind,
      count(*) AS n, CAST(sum(insert_len) AS BIGINT) AS inserted, CAST(sum(CASE WHEN op = 'D' THEN len ELSE 0 END) AS BIGINT) AS deleted FROM cols GROUP BY 1, 2""",
    "pileup_max_depth": f"""WITH {COLS}, n AS (SELECT contig, pos, read_id, row_number() OVER (PARTITION BY contig, pos ORDER BY read_id) AS n FROM cols)
      SELECT contig, pos, count(*) AS depth, CAST(sum(read_id % 1000003) AS BIGINT) AS ids FROM n WHERE n <= 8 GROUP BY contig, pos""",
    "pileup_mate_dedup": f"""WITH {COLS}, n AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, qname ORDER BY read_id) AS nth FROM cols),
      x AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, qname, CASE WHEN nth <= 2 THEN 0 ELSE nth END
        ORDER BY CASE WHEN qpos IS NULL THEN 1 ELSE 0 END, CASE WHEN flag & 64 <> 0 THEN 0 ELSE 1 END, read_id) AS rank FROM n)
      SELECT contig, pos, count(*) AS depth, count(qpos) AS match_depth FROM x WHERE rank = 1 GROUP BY contig, pos""",
    "depth_sweepline": f"""WITH {COLS}, x AS (SELECT contig, pos, count(*) AS depth FROM cols GROUP BY contig, pos)
      SELECT contig, count(*) AS covered, CAST(sum(depth) AS BIGINT) AS bases, max(depth) AS deepest FROM x GROUP BY contig""",
    "base_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "best_alt": f"WITH {COUNTS} SELECT contig, pos, alt, top AS n FROM best WHERE alt IS NOT NULL",
    "snv_calls": f"WITH {COUNTS} SELECT contig, pos, ref_base, alt, depth, alt_count, round(af, 6) AS af, gt FROM called",
    "vcf_lines": f"""WITH {COUNTS} SELECT contig, pos + 1 AS pos1, concat_ws(chr(9), contig, pos + 1, '.', ref_base, alt, '.', 'PASS',
      concat('DP=', depth, ';AF=', regexp_replace(regexp_replace(printf('%.4f', round(af, 4)), '0+$', ''), '\\.$', '')), 'GT', gt) AS line FROM called""",
    "mean_quality": f"WITH {BASED} SELECT contig, pos, CAST(sum(qual) AS BIGINT) AS quality, count(qual) AS n FROM usable WHERE qual IS NOT NULL GROUP BY contig, pos",
    "column_extras": f"""WITH {COLS}, g AS (SELECT contig, pos, concat('rg', read_id % 3) AS g, count(*) AS n, sum(matching / qlen) AS s FROM cols GROUP BY ALL)
      SELECT contig, pos, string_agg(concat(g, ':', n), ',' ORDER BY n DESC, g) AS groups, round(sum(s) / sum(n), 6) AS mean_fraction FROM g GROUP BY contig, pos""",
    "pileup_text": f"""WITH {BASED}, whole AS ({TEXTS}), t AS (
        SELECT based.*, read_pos = pos AS begins, pos = end_pos AS ends,
          CASE WHEN qpos IS NULL AND insert_len = 0 AND op = 'N' THEN CASE WHEN flag & 16 <> 0 THEN '<' ELSE '>' END WHEN qpos IS NULL THEN '*'
            WHEN base = ref_base THEN CASE WHEN flag & 16 <> 0 THEN ',' ELSE '.' END WHEN flag & 16 <> 0 THEN lower(base) ELSE base END AS shown,
          CASE WHEN insert_len > 0 THEN concat('+', insert_len, CASE WHEN qpos IS NULL OR seq IS NULL THEN ''
            WHEN flag & 16 <> 0 THEN lower(substr(seq, qpos + 2, insert_len)) ELSE substr(seq, qpos + 2, insert_len) END) ELSE '' END AS put
        FROM based LEFT JOIN whole USING (rid) WHERE true)
      SELECT contig, pos + 1 AS pos1, any_value(ref_base) AS ref_base, count(*) AS depth,
        string_agg(concat(CASE WHEN begins THEN concat('^', chr(33 + mapq)) ELSE '' END, shown, put, CASE WHEN ends THEN '$' ELSE '' END), '' ORDER BY read_pos, read_id) AS bases,
        string_agg(CASE WHEN coalesce(qual, 255) = 255 THEN '~' ELSE chr(33 + qual) END, '' ORDER BY read_pos, read_id) AS quals
      FROM t GROUP BY contig, pos""",
    "aligned_pairs": f"""WITH {OPS}, e AS (
        SELECT read_id, qs + j AS q, rs + j AS r, 1 AS n FROM ops, unnest(range(len)) AS t(j) WHERE op IN ('M', '=', 'X')
        UNION ALL SELECT read_id, CASE WHEN op = 'I' THEN qs END, CASE WHEN op <> 'I' THEN rs END, len FROM ops WHERE op IN ('I', 'D', 'N'))
      SELECT read_id, count(*) AS events, CAST(sum(q) AS BIGINT) AS q, CAST(sum(r) AS BIGINT) AS r, CAST(sum(n) AS BIGINT) AS bases FROM e GROUP BY read_id""",
    "matches_only": f"""WITH {OPS}, e AS (SELECT contig, op, rs + j AS p FROM ops, unnest(range(len)) AS t(j) WHERE op IN ('M', '=', 'X'))
      SELECT contig, op, count(*) AS n, CAST(sum(p) AS BIGINT) AS r FROM e GROUP BY contig, op""",
    "pairs_with_read": f"""WITH {QUERY}, e AS (SELECT contig, op, base, qual AS quality FROM letters WHERE k <> 14 AND op IN ('M', '=', 'X')
        UNION ALL SELECT contig, op, any_value(base) FILTER (WHERE j = 0), sum(qual) FROM letters WHERE k <> 14 AND op IN ('I', 'S') GROUP BY rid, i, contig, op)
      SELECT contig, op, base, count(*) AS n, CAST(sum(quality) AS BIGINT) AS quality FROM e GROUP BY contig, op, base""",
    "nm_tag": f"""WITH {QUERY}, m AS (SELECT rid, count(*) FILTER (WHERE op = 'M' AND (base <> {REF.format("w")} OR base = 'N')) AS m FROM letters WHERE k <> 14 GROUP BY rid),
      x AS (SELECT rid, CAST(coalesce(sum(len) FILTER (WHERE op = 'X'), 0) AS BIGINT) AS x, CAST(coalesce(sum(len) FILTER (WHERE op = 'I'), 0) AS BIGINT) AS i,
        CAST(coalesce(sum(len) FILTER (WHERE op = 'D'), 0) AS BIGINT) AS d FROM opened GROUP BY rid),
      n AS (SELECT read_id, coalesce(m, 0) + coalesce(x, 0) AS mismatches, coalesce(i, 0) AS inserted, coalesce(d, 0) AS deleted FROM reads LEFT JOIN m USING (rid) LEFT JOIN x USING (rid))
      SELECT read_id, mismatches + inserted + deleted AS nm, mismatches, inserted, deleted FROM n""",
    "md_tag": f"""WITH {QUERY}, b AS (SELECT rid, op, rs + j AS p, j FROM ops, unnest(range(len)) AS t(j) WHERE op IN ('M', 'D', '=', 'X') AND k <> 15),
      x AS (SELECT b.rid, b.op, b.p, b.j, {REF.format("b.p")} AS ref, b.op <> 'D' AND l.base = {REF.format("b.p")} AS same
        FROM b LEFT JOIN (SELECT * FROM letters WHERE op IN ('M', '=', 'X') AND k <> 14) l ON l.rid = b.rid AND l.w = b.p),
      y AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS run FROM x),
      z AS (SELECT rid, run, count(*) FILTER (WHERE same) AS n, max(CASE WHEN NOT same THEN CASE WHEN op = 'D' THEN CASE WHEN j = 0 THEN '^' ELSE '~' END ELSE '' END || ref END) AS t
        FROM y GROUP BY rid, run),
      t AS (SELECT rid, CASE WHEN min(run) = 1 THEN '0' ELSE '' END || replace(string_agg(CASE WHEN run = 0 THEN CAST(n AS VARCHAR) ELSE concat(t, n) END, '' ORDER BY run), '0~', '') AS md FROM z GROUP BY rid)
      SELECT read_id, coalesce(md, '0') AS md FROM reads LEFT JOIN t USING (rid) WHERE k <> 15""",
    "taps_methylation": f"""WITH {BASED} SELECT contig, pos, count(*) FILTER (WHERE qual >= 20 AND base = 'T') AS modified,
      count(*) FILTER (WHERE qual >= 20 AND base = 'C') AS unmodified FROM usable WHERE qpos IS NOT NULL AND ref_base = 'C' GROUP BY contig, pos""",
    "indel_evidence": f"""WITH {OPS} SELECT contig, count(*) FILTER (WHERE op = 'I') AS insertions, CAST(coalesce(sum(len) FILTER (WHERE op = 'I'), 0) AS BIGINT) AS inserted,
      count(*) FILTER (WHERE op = 'D') AS deletions, CAST(coalesce(sum(len) FILTER (WHERE op = 'D'), 0) AS BIGINT) AS deleted,
      CAST(coalesce(sum(len) FILTER (WHERE op = 'X'), 0) AS BIGINT) AS explicit_mismatches FROM ops GROUP BY contig""",
    "segments_plan": """WITH c AS (SELECT n_name AS contig, CAST(n_nationkey * 7919 AS BIGINT) AS length, 0 AS a, CAST(n_nationkey * 7919 - 1 AS BIGINT) AS z FROM nation WHERE n_nationkey > 0),
      s AS (SELECT *, j * 10000 AS core_start, least(j * 10000 + 9999, z) AS core_end FROM c, unnest(range((length + 9999) // 10000)) AS t(j))
      SELECT contig, greatest(core_start - 250, a) AS start, least(core_end + 250, z) AS "end", core_start, core_end,
        greatest(core_start - 250, a) = 0 AS at_start, least(core_end + 250, z) = length - 1 AS at_end FROM s""",
    "segmented_pileup": f"WITH {COLS} SELECT contig, pos, count(*) AS depth FROM cols GROUP BY contig, pos",
    "overlap_join": f"""WITH {READS}, t AS (SELECT concat('chr', s_suppkey % 3 + 1) AS contig, s_suppkey AS target, s_suppkey * 83 % 9000 AS a,
        s_suppkey * 83 % 9000 + s_suppkey % 400 AS z FROM supplier)
      SELECT target, count(*) AS n, CAST(sum(read_id % 1000003) AS BIGINT) AS ids FROM reads e JOIN t ON e.contig = t.contig AND e.pos <= t.z AND e.end_pos >= t.a GROUP BY target""",
    "merge_intervals": f"""WITH {READS}, i AS (SELECT contig, pos * 97 + read_id % 97 AS a, pos * 97 + read_id % 97 + qlen * (mapq % 7) AS z FROM reads),
      m AS (SELECT *, max(z) OVER (PARTITION BY contig ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
      s AS (SELECT *, sum(CASE WHEN b IS NULL OR a > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m)
      SELECT contig, min(a) AS start, max(z) AS "end", count(*) AS n FROM s GROUP BY contig, g""",
    "bin_numbers": f"""WITH {READS}, b AS (SELECT pos * 977 AS a, pos * 977 + qlen * 50 - 1 AS z FROM reads),
      c AS (SELECT CASE WHEN a >> 14 = z >> 14 THEN 4681 + (a >> 14) WHEN a >> 17 = z >> 17 THEN 585 + (a >> 17) WHEN a >> 20 = z >> 20 THEN 73 + (a >> 20)
        WHEN a >> 23 = z >> 23 THEN 9 + (a >> 23) WHEN a >> 26 = z >> 26 THEN 1 + (a >> 26) ELSE 0 END AS bin FROM b)
      SELECT bin, CAST(CASE WHEN bin >= 4681 THEN 5 WHEN bin >= 585 THEN 4 WHEN bin >= 73 THEN 3 WHEN bin >= 9 THEN 2 WHEN bin >= 1 THEN 1 ELSE 0 END AS INTEGER) AS level,
        CAST(CASE WHEN bin >= 4681 THEN 16384 WHEN bin >= 585 THEN 131072 WHEN bin >= 73 THEN 1048576 WHEN bin >= 9 THEN 8388608 WHEN bin >= 1 THEN 67108864 ELSE 536870912 END AS BIGINT) AS span,
        count(*) AS n FROM c GROUP BY bin""",
    "region_bins": f"""WITH {READS}, b AS (SELECT read_id, pos * 977 AS a, pos * 977 + qlen * 50 - 1 AS z FROM reads),
      c AS (SELECT read_id, CASE WHEN a >> 14 = z >> 14 THEN 4681 + (a >> 14) WHEN a >> 17 = z >> 17 THEN 585 + (a >> 17) WHEN a >> 20 = z >> 20 THEN 73 + (a >> 20)
        WHEN a >> 23 = z >> 23 THEN 9 + (a >> 23) WHEN a >> 26 = z >> 26 THEN 1 + (a >> 26) ELSE 0 END AS bin FROM b)
      SELECT read_id, bin FROM c WHERE bin = 0 OR bin BETWEEN 1 + (1000000 >> 26) AND 1 + (1199999 >> 26) OR bin BETWEEN 9 + (1000000 >> 23) AND 9 + (1199999 >> 23)
        OR bin BETWEEN 73 + (1000000 >> 20) AND 73 + (1199999 >> 20) OR bin BETWEEN 585 + (1000000 >> 17) AND 585 + (1199999 >> 17) OR bin BETWEEN 4681 + (1000000 >> 14) AND 4681 + (1199999 >> 14)""",
    "faidx_offsets": "SELECT p_partkey, 6 + (p_partkey * 37 // 60) * 61 + p_partkey * 37 % 60 AS \"offset\" FROM part",
    "block_lookup": """WITH m AS (SELECT j * 3000 + j % 7 + CASE WHEN j > 200 THEN 40000 ELSE 0 END AS mark, j * 300 AS value FROM range(1, 300) AS t(j)
        UNION ALL SELECT 0, 0), p AS (SELECT p_partkey * 7919 % 10000 * 100 AS "at" FROM part)
      SELECT "at", value AS block, "at" - mark AS within FROM p ASOF JOIN m ON p."at" >= m.mark""",
    "base_mods": f"WITH {MODS} SELECT read_id, code AS mod, count(*) AS n, CAST(sum(qpos) AS BIGINT) AS q, CAST(sum(prob) AS BIGINT) AS prob FROM found GROUP BY read_id, code",
    "methylation_freq": f"""WITH {MODS} SELECT contig, w AS rpos, code AS mod, count(*) FILTER (WHERE prob >= 128) AS modified, count(*) FILTER (WHERE prob < 128) AS unmodified,
      round(count(*) FILTER (WHERE prob >= 128) / count(*), 6) AS frequency FROM found WHERE k <> 14 AND op IN ('M', '=', 'X') GROUP BY contig, w, code""",
    "aux_tags": """SELECT l_orderkey, l_linenumber, l_orderkey % 300 AS nm, concat('grp', l_orderkey % 300) AS rg, CAST(concat(l_orderkey % 300, '.5') AS DOUBLE) AS score,
      '1AE301' AS bytes, concat('NM:i:', l_orderkey % 300, ' RG:Z:grp', l_orderkey % 300, ' XH:H:1AE301 XX:i:5') AS fields FROM lineitem""",
    "tag_widths": """WITH x AS (SELECT o_orderkey * 7919 % 200000 - 50000 AS x FROM orders)
      SELECT CASE WHEN x BETWEEN 0 AND 255 THEN 'C' WHEN x BETWEEN -128 AND -1 THEN 'c' WHEN x BETWEEN 0 AND 65535 THEN 'S' WHEN x BETWEEN -32768 AND -1 THEN 's' WHEN x >= 0 THEN 'I' ELSE 'i' END AS unsigned_first,
        CASE WHEN x BETWEEN -128 AND 127 THEN 'c' WHEN x BETWEEN 128 AND 255 THEN 'C' WHEN x BETWEEN -32768 AND 32767 THEN 's' WHEN x BETWEEN 32768 AND 65535 THEN 'S' ELSE 'i' END AS signed_first, count(*) AS n
      FROM x GROUP BY 1, 2""",
    "allele_kinds": """WITH s AS (SELECT regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g') AS s, p_size % 3 AS i, p_partkey % 4 AS j FROM part), a AS (SELECT substr(s, 1, CAST(i AS INTEGER)) AS r, substr(s, 1, CAST(j AS INTEGER)) AS a FROM s)
      SELECT CASE WHEN r = '' OR a = '' OR r = a THEN NULL WHEN length(r) = 1 AND length(a) = 1 THEN 'snv' WHEN length(r) = 1 THEN 'insertion' WHEN length(a) = 1 THEN 'deletion' ELSE 'complex' END AS kind, count(*) AS n FROM a GROUP BY 1""",
    "genotype_texts": """SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '.' ELSE CAST(p_size % 3 AS VARCHAR) END, CASE WHEN p_size % 2 = 0 THEN '|' ELSE '/' END,
      CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE CAST(p_size % 5 AS VARCHAR) END) AS gt FROM part""",
    "encoded_text": """SELECT event_id, replace(replace(replace(replace(replace(props, '%', '%25'), ':', '%3A'), ';', '%3B'), '=', '%3D'), ',', '%2C') AS encoded FROM events""",
    "float_texts": f"""WITH v AS (SELECT p_partkey AS k, CAST(p_partkey % 1000 / 8 * power(2.0, p_partkey % 60 - 30) * CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS FLOAT) AS x FROM part)
      SELECT k AS p_partkey, CASE k % 50 WHEN 0 THEN '.' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE {SIX.format("x")} END AS text FROM v""",
    "profile_percentiles": """SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(quantile_cont(l_quantity, 0.99), 6) AS p99
      FROM lineitem GROUP BY l_returnflag""",
    "sam_round_trip": BACK + " WHERE flag & 4 = 0",
    "reference_fetch": """WITH r AS (SELECT s_suppkey, s_suppkey * 97 % 9000 AS a, s_suppkey * 97 % 9000 + s_suppkey % 900 AS z FROM supplier)
      SELECT s_suppkey, coalesce(string_agg(substr('ACGT', CAST((p * 7 + p // 3) % 4 + 1 AS INTEGER), 1), '' ORDER BY p), '') AS seq
      FROM r LEFT JOIN range(10000) AS t(p) ON p >= a AND p < z GROUP BY s_suppkey""",
    "walk_soft_clips": f"""WITH {OPS}, f AS (SELECT rid, i = 0 AND op = 'M' AND len > 12 AS moves, op, len, contig FROM ops),
      e AS (SELECT contig, op, len FROM f WHERE NOT moves AND op IN ('M', '=', 'X', 'I', 'D', 'N', 'S') UNION ALL SELECT contig, 'S', 12 FROM f WHERE moves UNION ALL SELECT contig, 'M', len - 12 FROM f WHERE moves)
      SELECT contig, op, CAST(sum(CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 1 END) AS BIGINT) AS n, CAST(sum(len) AS BIGINT) AS bases FROM e GROUP BY contig, op""",
    "unmodified_calls": f"""WITH {MODS}, six AS (SELECT rid, read_id % 8 AS v, base FROM letters WHERE qpos = 5 AND read_id % 8 < 7),
      called AS (SELECT DISTINCT rid FROM found WHERE qpos = 5), dots(v, base) AS (VALUES (1, 'C'), (5, 'C'), (5, 'A'), (6, 'C'))
      SELECT six.base, CASE WHEN c.rid IS NOT NULL THEN 'false' WHEN dots.v IS NOT NULL THEN 'true' ELSE 'unknown' END AS unmodified, count(*) AS n
      FROM six LEFT JOIN called c USING (rid) LEFT JOIN dots ON dots.v = six.v AND dots.base = six.base GROUP BY 1, 2""",
    "aligned_fraction": f"WITH {READS} SELECT read_id, round(matching / qlen, 6) AS fraction FROM reads",
    "contig_extents": f"WITH {READS} SELECT contig, min(pos) AS first, max(end_pos) AS last, count(*) AS n, count(DISTINCT qname) AS templates FROM reads GROUP BY contig",
    "walk_sizes": f"""WITH {READS}, e AS (SELECT rid, op, CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 1 END AS n FROM opened)
      SELECT read_id, CAST(coalesce(sum(n) FILTER (WHERE op IN ('M', '=', 'X', 'I', 'D', 'N')), 0) AS BIGINT) AS plain,
        CAST(coalesce(sum(n) FILTER (WHERE op IN ('M', '=', 'X', 'I', 'D', 'N', 'S')), 0) AS BIGINT) AS clips,
        CAST(coalesce(sum(n) FILTER (WHERE op <> 'H'), 0) AS BIGINT) AS whole FROM reads LEFT JOIN e USING (rid) GROUP BY read_id""",
    "column_spans": f"""WITH {READS} SELECT contig, min(pos) AS first, max(end_pos) AS last, max(end_pos) - min(pos) + 1 AS positions FROM reads WHERE flag & 4 = 0 GROUP BY contig""",
    "pileup_text_trimmed": f"""WITH {BASED}, whole AS ({TEXTS}), t AS (
        SELECT based.*, read_pos = pos AS begins, pos = CASE WHEN k = 12 THEN end_pos - 3 ELSE end_pos END AS ends,
          CASE WHEN qpos IS NULL AND insert_len = 0 AND op = 'N' THEN CASE WHEN flag & 16 <> 0 THEN '<' ELSE '>' END WHEN qpos IS NULL THEN '*'
            WHEN base = ref_base THEN CASE WHEN flag & 16 <> 0 THEN ',' ELSE '.' END WHEN flag & 16 <> 0 THEN lower(base) ELSE base END AS shown,
          CASE WHEN insert_len > 0 THEN concat('+', insert_len, CASE WHEN qpos IS NULL OR seq IS NULL THEN ''
            WHEN flag & 16 <> 0 THEN lower(substr(seq, qpos + 2, insert_len)) ELSE substr(seq, qpos + 2, insert_len) END) ELSE '' END AS put
        FROM based LEFT JOIN whole USING (rid) WHERE NOT (k = 12 AND i = 2))
      SELECT contig, pos + 1 AS pos1, count(*) AS depth,
        string_agg(concat(CASE WHEN begins THEN concat('^', chr(33 + mapq)) ELSE '' END, shown, put, CASE WHEN ends THEN '$' ELSE '' END), '' ORDER BY read_pos, read_id) AS bases
      FROM t GROUP BY contig, pos""",
    "pairs_with_reference": f"""WITH {OPS}, b AS (SELECT rid, i, contig, op, rs, rs + j AS p, CASE WHEN rs + j < 8000 THEN {REF.format("(rs + j)")} END AS base
        FROM ops, unnest(range(len)) AS t(j) WHERE op IN ('M', '=', 'X', 'D')),
      e AS (SELECT contig, op, coalesce(base, '?') AS ref_bases, p AS r FROM b WHERE op <> 'D'
        UNION ALL SELECT contig, op, CASE WHEN count(*) = count(base) THEN string_agg(base, '' ORDER BY p) ELSE '?' END, min(rs) FROM b WHERE op = 'D' GROUP BY rid, i, contig, op)
      SELECT contig, op, ref_bases, count(*) AS n, CAST(sum(r) AS BIGINT) AS r FROM e GROUP BY contig, op, ref_bases""",
    "nm_of_table": f"""WITH {QUERY}, m AS (SELECT rid, count(*) FILTER (WHERE op = 'M' AND w BETWEEN 900 AND 1999 AND (base <> {REF.format("w")} OR base = 'N')) AS m FROM letters GROUP BY rid),
      x AS (SELECT rid, coalesce(sum(len) FILTER (WHERE op = 'X'), 0) AS x, coalesce(sum(len) FILTER (WHERE op IN ('I', 'D')), 0) AS g FROM opened GROUP BY rid)
      SELECT read_id, CAST(coalesce(m, 0) + x + g AS BIGINT) AS nm, CAST(coalesce(m, 0) + x AS BIGINT) AS mismatches
      FROM reads JOIN x USING (rid) LEFT JOIN m USING (rid) WHERE contig = 'chr1' AND flag & 4 = 0 AND pos <= 2000 AND end_pos >= 1000""",
    "snv_evidence": f"""WITH {QUERY}, e AS (SELECT contig, op, base, {REF.format("w")} AS ref FROM letters WHERE k <> 14 AND op IN ('M', '=', 'X') AND base <> 'N')
      SELECT contig, op, count(*) FILTER (WHERE base = ref) AS equal, count(*) FILTER (WHERE base <> ref) AS different FROM e GROUP BY contig, op""",
    "segments_of_targets": """WITH n AS (SELECT n_name AS contig, CAST(n_nationkey * 7919 AS BIGINT) AS length FROM nation),
      c AS (SELECT contig, length, CAST(1000 AS BIGINT) AS a, CAST(19999 AS BIGINT) AS z, 0 AS target FROM n WHERE contig = 'CANADA'
        UNION ALL SELECT contig, length, 39999, length - 1, 1 FROM n WHERE contig = 'FRANCE'
        UNION ALL SELECT contig, length, 0, length - 1, 2 FROM n WHERE contig = 'CHINA' UNION ALL SELECT contig, length, 0, 12344, 3 FROM n WHERE contig = 'JAPAN'),
      s AS (SELECT *, a + j * 4000 AS core_start, least(a + j * 4000 + 3999, z) AS core_end FROM c, unnest(range((z - a) // 4000 + 1)) AS t(j))
      SELECT contig, greatest(core_start - 100, a) AS start, least(core_end + 100, z) AS "end", core_start, core_end,
        greatest(core_start - 100, a) = 0 AS at_start, least(core_end + 100, z) = length - 1 AS at_end, target FROM s""",
    "modified_columns": f"""WITH {MODS} SELECT contig, w AS pos, code AS mod, count(*) AS n, CAST(sum(prob) AS BIGINT) AS prob FROM found
      WHERE flag & 4 = 0 AND op IN ('M', '=', 'X') GROUP BY contig, w, code""",
    "array_tags": """SELECT p_partkey, concat('XC:A:', substr(p_brand, 1, 1), ' XF:B:f,', printf('%.1f', p_partkey / 2), ' XS:B:s,', -p_partkey, ',', p_partkey * 2) AS fields,
      CAST(p_partkey AS DOUBLE) AS total FROM part""",
    "allele_texts": """WITH b AS (SELECT p_partkey, p_partkey % 6 AS k, p_size, substr('ACGT', CAST(p_size % 4 + 1 AS INTEGER), 1) AS b1, substr('ACGT', CAST(p_size * 2 % 4 + 1 AS INTEGER), 1) AS b2,
        substr('ACGT', CAST(p_size * 3 % 4 + 1 AS INTEGER), 1) AS b3, substr('TTGCA', 1, CAST(p_size % 4 AS INTEGER)) AS more FROM part),
      a AS (SELECT p_partkey, CASE WHEN k = 0 THEN true WHEN k = 1 THEN b1 <> b3 WHEN k = 2 THEN b1 <> b2 AND b1 <> b3 AND b2 <> b3 WHEN k IN (3, 4) THEN more <> '' ELSE true END AS fine,
        CASE WHEN k IN (4, 5) THEN concat(b1, more) ELSE b1 END AS ref,
        CASE k WHEN 0 THEN '' WHEN 1 THEN b3 WHEN 2 THEN concat(b2, ',', b3) WHEN 3 THEN concat(b1, more) WHEN 4 THEN b1 ELSE '<DEL>,T' END AS alts,
        CAST(CASE WHEN k = 0 THEN 1 WHEN k IN (2, 5) THEN 3 ELSE 2 END AS INTEGER) AS number FROM b)
      SELECT p_partkey, CASE WHEN fine THEN ref END AS ref, CASE WHEN fine THEN alts END AS alts, CAST(CASE WHEN fine THEN length(ref) END AS INTEGER) AS span, CASE WHEN fine THEN number END AS number FROM a""",
    "vcf_records": f"""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_brand AS brand FROM part),
      f AS (SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE concat('DP=', k, ';') END AS dp1, CASE WHEN k % 5 = 0 THEN concat(';DP=', s) ELSE '' END AS dp2,
        CASE k % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'q10;s50' ELSE '.' END AS passed, CASE WHEN k % 2 = 1 THEN {SIX.format("CAST(k / 16 AS FLOAT)")} ELSE '.' END AS qual,
        CASE WHEN k % 3 = 0 THEN '.' ELSE CAST(s % 3 AS VARCHAR) END AS a, CASE WHEN k % 5 = 0 THEN '.' ELSE CAST(s % 5 AS VARCHAR) END AS b,
        CASE WHEN k % 2 = 0 THEN '.' ELSE CAST(s % 2 AS VARCHAR) END AS c FROM p)
      SELECT k AS p_partkey, concat_ws(chr(9), 'c1', k, '.', 'A', 'C,T', qual, passed,
        concat(dp1, 'AF=', {SIX.format("CAST(k / 7 AS FLOAT)")}, ';AD=', k, ',', s, ';Q=', {SIX.format("CAST(k / 4 AS FLOAT)")}, ',', {SIX.format("CAST(k / 8 AS FLOAT)")},
          CASE WHEN s % 2 = 0 THEN ';DB' ELSE '' END, ';NAME=', brand, '%3Da%3Bb%2C100%25;OPT=', CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE '.' END, ',', s, dp2),
        'GT:DP:GQ', concat(a, CASE WHEN s % 2 = 0 THEN '|' ELSE '/' END, b, ':', k, ':', {SIX.format("CAST(k / 3 AS FLOAT)")}),
        concat(c, CASE WHEN s % 2 = 1 THEN '|' ELSE '/' END, c, ':', s, ':', CASE WHEN k % 4 = 0 THEN {SIX.format("CAST(k / 9 AS FLOAT)")} ELSE '.' END)) AS line FROM f""",
    "bam_round_trip": BACK,
    "bam_region": f"WITH {READS} SELECT qname, flag, contig, pos, cigar FROM reads WHERE contig = 'chr1' AND flag & 4 = 0 AND pos <= 2000 AND end_pos >= 1000 AND mapq >= 30",
    "sam_gz_region": f"""WITH {QUERY} SELECT qname, flag, contig, pos, cigar, coalesce(seq, '') AS seq FROM reads LEFT JOIN texts USING (rid)
      WHERE contig = 'chr2' AND flag & 4 = 0 AND pos <= 4000 AND end_pos >= 3000""",
    "vcf_round_trip": f"WITH {COUNTS} SELECT contig, pos + 1 AS pos1, ref_base AS ref, alt, depth, gt FROM called",
    "fasta_round_trip": f"""SELECT concat('s', s_suppkey) AS name, string_agg({REF.format("(p + s_suppkey)")}, '' ORDER BY p) AS seq FROM supplier, unnest(range(1, s_suppkey % 200 + 2)) AS t(p) GROUP BY s_suppkey""",
    "fastq_round_trip": f"""WITH {QUERY}, q AS (SELECT rid, CAST(sum(least(qual, 93)) AS INTEGER) AS capped FROM letters GROUP BY rid)
      SELECT concat('r', read_id) AS qname, CAST(4 + 1 + 8 + CASE WHEN flag & 64 <> 0 THEN 64 ELSE 128 END + CASE WHEN mapq < 5 THEN 512 ELSE 0 END AS INTEGER) AS flag, seq, capped AS quality, 'ACGT' AS barcode
      FROM reads JOIN texts USING (rid) JOIN q USING (rid)""",
    "walk_everything": f"""WITH {OPS}, e AS (SELECT contig, op, 1 AS n, qs + j AS q, rs + j AS r FROM ops, unnest(range(len)) AS t(j) WHERE op IN ('M', '=', 'X')
        UNION ALL SELECT contig, op, len, CASE WHEN op IN ('I', 'S') THEN qs END, CASE WHEN op IN ('D', 'N') THEN rs END FROM ops WHERE op IN ('I', 'D', 'N', 'S', 'P'))
      SELECT contig, op, count(*) AS n, CAST(sum(n) AS BIGINT) AS bases, CAST(sum(q) AS BIGINT) AS q, CAST(sum(r) AS BIGINT) AS r FROM e GROUP BY contig, op""",
    "opened_pileup": f"""WITH {COLS} SELECT contig, pos, {REFBASE} AS ref_base, count(*) AS depth FROM cols WHERE contig = 'chr2' AND pos BETWEEN 500 AND 899 GROUP BY contig, pos""",
    "reference_ranges": f"""WITH r AS (SELECT s_suppkey, s_suppkey * 97 % 900 AS a, s_suppkey * 97 % 900 + s_suppkey % 90 AS z FROM supplier)
      SELECT s_suppkey, CASE WHEN min(a) >= 100 AND min(z) < 800 THEN string_agg({REF.format("p")}, '' ORDER BY p) END AS bases FROM r, unnest(range(a, z + 1)) AS t(p) GROUP BY s_suppkey""",
}
