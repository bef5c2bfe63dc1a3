"""DuckDB SQL for those of the queries that SQL can say."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text: one step for each bit, the byte coming in with the first of its eight."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(4294967295, list_reduce({bits}, lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), CAST(4294967295 AS BIGINT)))"


WARC = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
    w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_page FROM d)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN last_page END AS refers_to,
           CAST(1 AS INTEGER) AS n_requests
    FROM w"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _conversations() -> str:
    # a path is its cost in nine digits and then its audit, so that the least string is the cheapest path; null is no path
    more = lambda x, cost, edit: f"(lpad(CAST(CAST(left({x}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || {edit})"
    late, alive = "(CASE WHEN fault = 't' THEN 3 ELSE 0 END)", "fault NOT IN ('b', 'd')"
    said = lambda x, to: f"CASE WHEN {alive} THEN " + more(x, f"{late} + CASE WHEN i = '{to}' THEN 0 ELSE 3 END", f"CASE WHEN i = '{to}' THEN 'K' ELSE 'R' END") + " END"
    gone = lambda x: more(x, 4, "'D'")
    put = lambda x: more(x, 3, "'I'")
    hit = crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {hit} % 20 AS d FROM conversations),
    dm AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS c FROM k WHERE d <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), c) AS n FROM dm),
    fl AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before, rtrim(text, {blanks}) AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM o),
    ff AS (SELECT *, CASE WHEN b = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM fl),
    f(conv_id, n, e, s, u, a) AS (
        SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000003I', '000000006II' FROM ff WHERE n = 1
        UNION ALL
        SELECT conv_id, n, e, s, u, least(a, {put("u")}) AS a FROM (
            SELECT conv_id, n, e, s, least(u, {put("e")}, {put("s")}, {put("a")}) AS u, a FROM (
                SELECT ff.conv_id, ff.n, {gone("e")} AS e, least({gone("s")}, CASE WHEN {alive} AND i = 's' THEN {more("e", late, "'K'")} END) AS s,
                    least({gone("u")}, {said("e", "u")}, {said("s", "u")}, {said("a", "u")}) AS u, least({gone("a")}, {said("u", "a")}) AS a
                FROM f JOIN ff ON ff.conv_id IS NOT DISTINCT FROM f.conv_id AND ff.n = f.n + 1))),
    best AS (SELECT conv_id, CAST(left(w, 9) AS BIGINT) AS cost, substr(w, 10) AS audit FROM (SELECT conv_id, arg_max(least(e, a), n) AS w FROM f GROUP BY 1)),
    ed AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
    eg AS (SELECT conv_id, p, substr(audit, p, 1) AS x, sum(CASE WHEN substr(audit, p, 1) <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN substr(audit, p, 1) <> 'D' THEN 1 ELSE 0 END) OVER w AS m FROM ed WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    es AS (SELECT eg.conv_id, p, x, m, CASE WHEN x = 'I' THEN '' ELSE text END AS text, role, max(CASE WHEN m = 1 AND x = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY eg.conv_id) AS sys
           FROM eg LEFT JOIN ff ON ff.conv_id IS NOT DISTINCT FROM eg.conv_id AND ff.n = eg.n),
    rp AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM es WHERE x <> 'D' GROUP BY 1),
    ct AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM ff GROUP BY 1)
    SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN ct ON ct.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM q.conv_id"""


def _merkle() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    hit = crc32("CAST(doc_id AS VARCHAR)")

    def levels(name: str, start: str) -> str:
        """The nodes of each level; n: how many the tree has there."""
        return f"""{name}(tree, level, idx, n, h) AS ({start} UNION ALL
            SELECT tree, level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 16)"""

    return f"""
    WITH RECURSIVE lf AS (SELECT doc_id, source, {leaf("text")} AS h, CASE WHEN {hit} % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf("text")} END AS claimed FROM documents),
    rk AS (SELECT source, CAST(row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS BIGINT) AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT source FROM documents)),
    pl AS (SELECT doc_id, tree, n_trees, h, claimed, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY tree) AS n FROM lf JOIN rk ON lf.source IS NOT DISTINCT FROM rk.source),
    {levels("nd", "SELECT tree, CAST(0 AS BIGINT), idx, n, h FROM pl")},
    sr AS (SELECT tree, level AS height, h AS subroot FROM nd WHERE n = 1),
    {levels("tp", "SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), tree, count(*) OVER (), subroot FROM sr")},
    rt AS (SELECT h AS root FROM tp WHERE n = 1),
    way AS (SELECT doc_id, tree, level AS k, level, tree AS t, idx // CAST(power(16, level) AS BIGINT) AS own FROM pl JOIN (SELECT DISTINCT tree, level FROM nd WHERE n > 1) USING (tree)
            UNION ALL SELECT doc_id, tree, height + level, level, -1, tree // CAST(power(16, level) AS BIGINT) FROM pl JOIN sr USING (tree), (SELECT DISTINCT level FROM tp WHERE n > 1)),
    al AS (SELECT * FROM nd UNION ALL SELECT * FROM tp),
    st AS (SELECT way.doc_id, way.tree, k, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') AS before, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS after
           FROM way JOIN al ON al.tree = t AND al.level = way.level AND al.idx // 16 = own // 16 GROUP BY 1, 2, 3),
    fd(doc_id, k, h) AS (SELECT doc_id, CAST(0 AS BIGINT), claimed FROM pl UNION ALL SELECT fd.doc_id, fd.k + 1, sha256(before || h || after) FROM fd JOIN st ON st.doc_id = fd.doc_id AND st.k = fd.k),
    ed AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fd GROUP BY 1),
    pf AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM st GROUP BY 1)
    SELECT doc_id, h AS leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM pl JOIN sr USING (tree) JOIN ed USING (doc_id) LEFT JOIN pf USING (doc_id), rt"""


def _shards() -> str:
    # the groups' running sums are one list, l; a shard from s on ends greedily at the largest sum that isn't above s + its capacity
    last = lambda limit, start: f"coalesce(list_max(list_filter(l, lambda x: x <= {limit})), {start})"
    first = lambda least: f"CASE WHEN {least} <= 0 THEN 0 ELSE list_min(list_filter(l, lambda x: x >= {least})) END"
    fits = f"list_reduce(range(8), lambda s, i: {last('s + mid', 's')}, CAST(0 AS BIGINT)) = total"
    bytes_of = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    bits = f"flatten(list_transform({bytes_of}, lambda c: [c, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, coalesce(list_reduce({bits}, lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), CAST(4294967295 AS BIGINT)), 4294967295))"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc} AS text_crc32 FROM documents),
    g AS (SELECT t, min(doc_id) AS f, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY 1),
    u AS (SELECT t, bytes, CAST(sum(bytes) OVER (ORDER BY f NULLS FIRST, md5(t)) AS BIGINT) AS upto FROM g),
    k AS (SELECT list(upto ORDER BY upto) AS l, max(upto) AS total, max(bytes) AS largest FROM u),
    b(low, high) AS (SELECT greatest((total + 7) // 8, largest) - 1, (total + 7) // 8 + largest FROM k
        UNION ALL SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (SELECT low, high, mid, {fits} AS ok FROM (SELECT low, high, (low + high) // 2 AS mid FROM b WHERE high - low > 1), k)),
    c AS (SELECT min(high) AS cap FROM b),
    r(left_over, pos) AS (SELECT 0, total FROM k UNION ALL SELECT left_over + 1, {first("pos - cap")} FROM r, c, k WHERE left_over < 7),
    p(left_over, pos) AS (SELECT 8, CAST(0 AS BIGINT) UNION ALL
        SELECT left_over - 1, CASE WHEN pos = total THEN pos ELSE list_sort(list_transform(list_filter([below, above, fit], lambda x: x >= greatest(need, pos + 1) AND x <= pos + cap), lambda x: {{'d': abs(x - share), 'x': x}}))[1].x END FROM (
            SELECT *, CASE WHEN share < fit THEN least({first("share + 1")}, fit) ELSE fit END AS above FROM (
                SELECT *, {last("greatest(share, pos)", "pos")} AS below, {last("least(pos + cap, total)", "pos")} AS fit FROM (
                    SELECT p.left_over, p.pos, r.pos AS need, p.pos + (total - p.pos) // p.left_over AS share, l, total, cap FROM p JOIN r ON r.left_over = p.left_over - 1, k, c WHERE p.left_over > 1)))),
    e AS (SELECT pos FROM p WHERE left_over < 8),
    s AS (SELECT t, upto, CAST((SELECT count(*) FROM e WHERE e.pos < u.upto) AS INTEGER) AS shard FROM u)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM d JOIN s USING (t)"""


def _jaccard() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\t-\\r]+')"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
    g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], true), lambda x: x[1] || ' ' || x[2] || ' ' || x[3] || ' ' || x[4])) END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM g),
    e AS (SELECT doc_id, unnest(s) AS s FROM g),
    c AS (SELECT s FROM e GROUP BY 1 HAVING count(*) > 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM c JOIN e x USING (s) JOIN e y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, least(a, min(b)) AS root FROM r GROUP BY 1)
    SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id FROM n LEFT JOIN m ON a = doc_id"""


ORACLES = {"op1_warc_transactions": WARC, "op3_ngram_jaccard": _jaccard(), "op11_conversation_repair": _conversations(), "op12_minimax_shards": _shards(), "op13_merkle_manifest": _merkle()}
