"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, conversations, decontaminate, html, jaccard, licenses, line_dedup, minhash, quality, shards, token_counts, urls
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("row_hash")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(conversations.damaged(table(spark, sf_dir, "conversations")))


TEXT_QUERIES = (op1_line_dedup, op2_shards, op3_licenses, op4_decontaminate, op5_bpe, op6_urls, op7_quality, op8_jaccard, op9_html, op10_token_counts, op11_minhash, op12_codebooks, op13_conversations)
QUERIES = {f.__name__: f for f in TEXT_QUERIES}

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
     k AS (SELECT r, doc_id, pos, line,
                  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.r, k.doc_id, k.pos, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone
           FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
FROM m GROUP BY r
"""

SQL["op4_decontaminate"] = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM benchmark WHERE item_id IS NOT NULL),
     bl AS (SELECT item, words, least(10, len(words)) AS k FROM b WHERE len(words) > 0),
     bw AS (SELECT DISTINCT item, k, array_to_string(words[i : i + k - 1], ' ') AS win
            FROM (SELECT item, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM bl)),
     ks AS (SELECT DISTINCT k FROM bl),
     dw AS (SELECT r, k, i, array_to_string(words[i : i + k - 1], ' ') AS win
            FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, ks WHERE len(words) >= k)),
     hit AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
     n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
     t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON w.r = n.r LEFT JOIN t ON w.r = t.r
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LICENSES = ", ".join(
    f"({t.number}, '{t.label}', {list(t.words)!r}, '{' '.join(t.must)}', {list(t.never)!r}::VARCHAR[], {t.need}, {t.span})" for t in licenses.prepare(licenses.TEMPLATES, licenses.THRESHOLD)
)

SQL["op3_licenses"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_LOWER.format("text")} AS low FROM documents),
     w AS (SELECT doc_id, r, {_WORDS.format("low")} AS words FROM d),
     p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w),
     q AS (SELECT r, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY pos)),
     b AS (SELECT r, pos, CASE WHEN word = 'mit' AND w2 = 'license' THEN 'mit' WHEN word = 'apache' AND w2 = 'license' THEN 'apache'
                              WHEN word = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' END AS label FROM q),
     base AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM b WHERE label IS NOT NULL GROUP BY r),
     t AS (SELECT * FROM (VALUES {_LICENSES}) t(k, label, tw, must, never, need, span)),
     tk AS (SELECT k, unnest(tw) AS word FROM t),
     nv AS (SELECT k, unnest(never) AS word FROM t),
     par AS (SELECT r, generate_subscripts(ps, 1) AS par, unnest(ps) AS part FROM (SELECT r, string_split_regex(low, '\n[ \t\r\x0B\x0C]*\n') AS ps FROM d)),
     pw AS (SELECT r, par, {_WORDS.format("part")} AS words FROM par),
     few AS (SELECT r, par, k FROM (SELECT r, par, unnest(list_distinct(words)) AS word FROM pw) JOIN tk USING (word) JOIN t USING (k) GROUP BY r, par, k, need HAVING count(*) >= need),
     occ AS (SELECT r, par, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM pw WHERE (r, par) IN (SELECT r, par FROM few)),
     mine AS MATERIALIZED (SELECT r, par, k, pos, word FROM few JOIN occ USING (r, par) JOIN tk USING (k, word)),
     bad AS (SELECT r, par, k, pos FROM few JOIN occ USING (r, par) JOIN nv USING (k, word)),
     starts AS (SELECT m.r, m.par, m.k, m.pos AS s, least(m.pos + any_value(t.span), coalesce(min(bad.pos), m.pos + any_value(t.span))) AS e
                FROM mine m JOIN t ON t.k = m.k LEFT JOIN bad ON bad.r = m.r AND bad.par = m.par AND bad.k = m.k AND bad.pos >= m.pos GROUP BY m.r, m.par, m.k, m.pos),
     runs AS (SELECT s.r, s.k, s.par, s.s, s.e, list(DISTINCT m.word) AS got FROM starts s JOIN mine m ON m.r = s.r AND m.par = s.par AND m.k = s.k AND m.pos >= s.s AND m.pos < s.e GROUP BY ALL),
     found AS (SELECT r, list(DISTINCT label) AS labels, max(len(got)::DOUBLE / len(tw)) AS score FROM runs JOIN t USING (k) JOIN pw USING (r, par)
               WHERE len(got) >= need AND (must = '' OR contains(' ' || array_to_string(pw.words[s : e - 1], ' ') || ' ', ' ' || must || ' ')) GROUP BY r)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.lo AS first_word, base.hi AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       coalesce(found.score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN base ON base.r = w.r LEFT JOIN found ON found.r = w.r
"""

def _components_sql(words: int, similar: int, more: str = "") -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
     s AS (SELECT DISTINCT r, array_to_string(words[i : i + {words - 1}], ' ') AS shingle
           FROM (SELECT r, words, unnest(range(1, greatest(1, len(words) - {words - 1}) + 1)) AS i FROM w WHERE len(words) > 0)),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     c AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
     e AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= {similar} * (x.n + y.n - common)),
     sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
     reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, sym.b FROM reach JOIN sym ON sym.a = reach.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id{more}
FROM w JOIN reach ON reach.a = w.r JOIN w o ON o.r = reach.b LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""


SQL["op8_jaccard"] = _components_sql(5, 80)
SQL["op11_minhash"] = _components_sql(3, 85, ", w.doc_id = min(o.doc_id) AS kept")


def _url_sql() -> str:
    ranked = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in ranked]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, ranked, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ranked, strict=True)) + " END"
    levels = "".join(
        f"""
     s{k} AS (SELECT *, CASE WHEN regexp_matches(segs[{k + 1}], '[0-9]') THEN '*' ELSE segs[{k + 1}] END AS seg FROM t{k}),
     w{k} AS (SELECT host, template FROM s{k} WHERE seg IS NOT NULL GROUP BY host, template HAVING count(DISTINCT seg) >= {urls.FANOUT}),
     u{k} AS (SELECT s.host, s.path, segs, labelled, blocked, branches, seg,
             s.template || CASE WHEN seg IS NULL THEN '' WHEN w.host IS NOT NULL THEN '/*' ELSE '/' || seg END AS template
             FROM s{k} s LEFT JOIN w{k} w ON w.host = s.host AND w.template = s.template),
     t{k + 1} AS MATERIALIZED (SELECT host, path, segs, labelled, blocked, template, CASE WHEN seg IS NULL THEN branches ELSE list_append(branches, template) END AS branches FROM u{k}),"""
        for k in range(urls.DEPTH)
    )
    m = f"{urls.STRENGTH}::DOUBLE"
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
     r AS (SELECT *, {rule} AS rule, {verdict} AS said FROM p),
     t0 AS (SELECT host, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked, '' AS template, [''] AS branches
            FROM r GROUP BY host, path),{levels}
     tree AS (SELECT host, path, labelled, blocked, CASE WHEN len(segs) > {urls.DEPTH} THEN template || '/**' ELSE template END AS template,
                     CASE WHEN len(segs) > {urls.DEPTH} THEN list_append(branches, template || '/**') ELSE branches END AS branches FROM t{urls.DEPTH}),
     leaf AS (SELECT host, template, branches, sum(labelled) AS labelled, sum(blocked) AS blocked FROM tree GROUP BY ALL),
     chain AS (SELECT host, labelled, blocked, generate_subscripts(branches, 1) AS level, unnest(branches) AS node, branches FROM leaf),
     nodes AS (SELECT host, level, node, CASE WHEN level > 1 THEN branches[level - 1] END AS parent, CAST(sum(labelled) AS DOUBLE) AS labelled, CAST(sum(blocked) AS DOUBLE) AS blocked FROM chain GROUP BY ALL),
     shares AS (SELECT *, (blocked + 1) / (labelled + 2) AS share FROM nodes),
     near AS (SELECT *, lag(share) OVER o AS ls, lag(labelled) OVER o AS ll FROM shares WINDOW o AS (PARTITION BY host, level, parent ORDER BY share, node)),
     apart AS (SELECT *, CASE WHEN share - ls > {urls.ALIKE}::DOUBLE * sqrt((share + ls) / 2 * (1 - (share + ls) / 2) * (1 / (labelled + 2) + 1 / (ll + 2))) THEN 1 ELSE 0 END AS gap FROM near),
     branch AS (SELECT *, sum(gap) OVER (PARTITION BY host, level, parent ORDER BY share, node) AS b FROM apart),
     pooled AS (SELECT host, level, node, sum(labelled) OVER (PARTITION BY host, level, parent, b) AS al, sum(blocked) OVER (PARTITION BY host, level, parent, b) AS bad FROM branch),
     total AS (SELECT (sum(blocked) + 1) / (sum(labelled) + 2) AS overall FROM leaf),
     steps AS (SELECT c.host, leaf.template, list(struct_pack(al := al, bad := bad, x := 0::DOUBLE) ORDER BY c.level) AS steps
               FROM leaf JOIN (SELECT host, template, generate_subscripts(branches, 1) AS level, unnest(branches) AS node FROM leaf) c ON c.host = leaf.host AND c.template = leaf.template
               JOIN pooled ON pooled.host = c.host AND pooled.level = c.level AND pooled.node = c.node GROUP BY c.host, leaf.template),
     judged AS (SELECT host, template, list_reduce(list_prepend(struct_pack(al := 0::DOUBLE, bad := 0::DOUBLE, x := overall::DOUBLE), steps),
                lambda a, s: struct_pack(al := 0::DOUBLE, bad := 0::DOUBLE, x := (s.bad + {m} * a.x) / (s.al + {m}))).x AS impurity FROM steps, total)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN j.impurity > {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN tree ON tree.host = r.host AND tree.path = r.path JOIN judged j ON j.host = tree.host AND j.template = tree.template
"""


SQL["op6_urls"] = _url_sql()


#: One edit by state: what a row of initial `r` and fault `f` may become, as (state before, state after, cost, letter). The
#: walk inserts up to two rows before each edit and after the last one; k counts rows.
SQL["op13_conversations"] = r"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
     crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(list_transform(string_split(key, ''), lambda ch: ascii(ch)::UBIGINT), lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))),
                    lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1::UBIGINT) * 3988292384::UBIGINT)), 4294967295::UBIGINT) % 20 AS kind FROM src),
     hurt AS (SELECT id, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, CASE WHEN kind = 3 THEN 2 ELSE 1 END AS copies FROM crc WHERE kind <> 0),
     r0 AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM (SELECT *, unnest(range(copies)) FROM hurt)),
     r1 AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
                   left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM r0),
     r AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r1),
     ins AS (SELECT * FROM (VALUES ('', '', 0, ''), ('', 'u', 1, 'I'), ('', 'a', 2, 'II'), ('s', 's', 0, ''), ('s', 'u', 1, 'I'), ('s', 'a', 2, 'II'),
                                   ('u', 'u', 0, ''), ('u', 'a', 1, 'I'), ('u', 'u', 2, 'II'), ('a', 'a', 0, ''), ('a', 'u', 1, 'I'), ('a', 'a', 2, 'II')) t(p, q, n, letters)),
     edit AS (SELECT conv_id, k, p, q, cost, letter FROM (
                SELECT conv_id, k, p, p AS q, 4 AS cost, 'D' AS letter FROM r, (VALUES (''), ('s'), ('u'), ('a')) t(p)
                UNION ALL SELECT conv_id, k, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM r, (VALUES ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) t(p, q) WHERE fault NOT IN ('blank', 'duplicate')
                UNION ALL SELECT conv_id, k, p, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K' FROM r, (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) t(p, q) WHERE i = q AND fault NOT IN ('blank', 'duplicate'))),
     step AS MATERIALIZED (SELECT conv_id, k, ins.p, edit.q, min(struct_pack(cost := 3 * n + cost, token := letters || letter)) AS best FROM edit JOIN ins ON ins.q = edit.p GROUP BY ALL),
     walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, '' AS state, struct_pack(cost := 0, audit := '') AS way FROM r
              UNION ALL
              SELECT walk.conv_id, walk.k + 1, step.q, min(struct_pack(cost := way.cost + best.cost, audit := way.audit || best.token))
              FROM walk JOIN step ON step.conv_id IS NOT DISTINCT FROM walk.conv_id AND step.k = walk.k + 1 AND step.p = walk.state GROUP BY walk.conv_id, walk.k, step.q),
     n AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
     done AS (SELECT n.conv_id, n.n, min(struct_pack(cost := way.cost + 3 * t.more, audit := way.audit || repeat('I', t.more))) AS way
              FROM walk JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id AND n.n = walk.k JOIN (VALUES ('', 0), ('s', 2), ('u', 1), ('a', 0)) t(state, more) ON t.state = walk.state GROUP BY n.conv_id, n.n),
     letters AS (SELECT conv_id, unnest(string_split(way.audit, '')) AS x, generate_subscripts(string_split(way.audit, ''), 1) AS nth FROM done WHERE way.audit <> ''),
     placed AS (SELECT *, count(*) FILTER (x <> 'I') OVER (PARTITION BY conv_id ORDER BY nth) AS k FROM letters),
     shown AS (SELECT placed.conv_id, nth, x, role, text, x = 'K' AND left(role, 1) = 's' AS sys, sum(CASE WHEN x = 'D' OR (x = 'K' AND left(role, 1) = 's') THEN 0 ELSE 1 END) OVER (PARTITION BY placed.conv_id ORDER BY nth) AS turn_no
               FROM placed LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM placed.conv_id AND r.k = placed.k AND placed.x <> 'I'),
     text_of AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN turn_no % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY nth) AS t FROM shown WHERE x <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(done.way.cost, 0) AS BIGINT) AS cost, coalesce(done.way.audit, '') AS audit, sha256(coalesce(text_of.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN text_of ON text_of.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _codebook_sql() -> str:
    """Six rounds of assignment and means, then the codes; vectors have a multiple of eight components here."""
    nearest = "SELECT b.pos, p.row, p.part, min(struct_pack(far := list_sum(list_transform(list_zip(p.part, b.part), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), entry := b.entry)) AS best FROM p JOIN b{0} b ON b.pos = p.pos GROUP BY b.pos, p.row, p.part"
    rounds = "".join(
        f"""
     a{k} AS MATERIALIZED ({nearest.format(k)}),
     m{k} AS (SELECT pos, best.entry AS entry, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS c FROM (SELECT pos, best, unnest(part) AS x, generate_subscripts(part, 1) AS k FROM a{k}) GROUP BY ALL),
     n{k} AS (SELECT pos, entry, list((s - ((s % c) + c) % c) // c ORDER BY k) AS part FROM m{k} GROUP BY ALL),
     b{k + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(n.part, b.part) AS part FROM b{k} b LEFT JOIN n{k} n ON n.pos = b.pos AND n.entry = b.entry),"""
        for k in range(6)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 4096) AS BIGINT)) AS ints FROM embeddings
           WHERE embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 0) = 0),
     p AS MATERIALIZED (SELECT pos, row, ints[pos * (len(ints) // 8) + 1 : (pos + 1) * (len(ints) // 8)] AS part FROM v, (SELECT unnest(range(8)) AS pos)),
     s AS (SELECT vec_id, min(ints) AS ints, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v GROUP BY vec_id ORDER BY vec_id LIMIT 16),
     b0 AS MATERIALIZED (SELECT pos, entry, ints[pos * (len(ints) // 8) + 1 : (pos + 1) * (len(ints) // 8)] AS part FROM s, (SELECT unnest(range(8)) AS pos)),{rounds}
     last AS ({nearest.format(6)}),
     codes AS (SELECT row, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM last GROUP BY row),
     sha AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS h FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN codes USING (row), sha
"""


SQL["op12_codebooks"] = _codebook_sql()
