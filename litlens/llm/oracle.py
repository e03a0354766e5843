"""DuckDB SQL for the queries that SQL can express on whole tables."""

SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)
    """,
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id
                                      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        crc AS (  -- CRC-32, a byte at a time, eight bits each
            SELECT c, xor(list_reduce(
                       list_prepend(4294967295::BIGINT,
                                    list_transform(range(1, length(c::VARCHAR) + 1),
                                                   lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                                lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
            FROM (SELECT DISTINCT c FROM own)),
        convs AS (SELECT c, c - c % 100 AS base, crc % 6 AS h FROM crc),
        rebuilt AS (
            SELECT v.c, 0 AS part, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
            UNION ALL
            SELECT v.c, 1, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
        member AS (
            SELECT c, row_number() OVER w AS d, length(text) AS chars,
                   string_agg(md5(length(role) || ':' || role || text), '') OVER w AS key
            FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, p ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT c, 0, 0, '' FROM convs),
        longest AS (SELECT c, max(d) AS d FROM member GROUP BY c),
        node AS (
            SELECT m.key, m.d, min(m.c) AS c, count(*) AS n, max(m.chars) AS chars,
                   sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (WHERE l.d = m.d), '')) AS ends
            FROM member m JOIN longest l USING (c) GROUP BY m.key, m.d),
        linked AS (
            SELECT n.*, up.key AS up, up.c AS up_c
            FROM node n LEFT JOIN member m ON m.c = n.c AND m.d = n.d - 1
                        LEFT JOIN node up ON up.key = m.key AND up.d = m.d),
        children AS (SELECT up, d - 1 AS d, count(*) AS k FROM linked WHERE up IS NOT NULL GROUP BY ALL),
        counted AS (SELECT l.*, coalesce(k, 0) AS k FROM linked l LEFT JOIN children x ON x.up = l.key AND x.d = l.d),
        below AS (
            SELECT m.key, m.d, count(*) FILTER (WHERE n.k = 0) AS leaves, sum((n.n - 1) * n.chars) AS saved
            FROM counted n JOIN member m ON m.c = n.c AND m.d <= n.d GROUP BY m.key, m.d)
        SELECT n.c AS conv_id, n.d::BIGINT AS depth, n.up_c AS parent_conv_id, n.n AS n_convs, n.k::BIGINT AS n_children,
               b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
        FROM counted n JOIN below b ON b.key = n.key AND b.d = n.d
    """,
    "op12_phrase_mining": r"""
        WITH piece AS (
            SELECT lang, row_number() OVER () AS id, p FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        worded AS (
            SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
                SELECT lang, id, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece)),
        phrase AS (
            SELECT lang, unnest([1, 2, 3]) AS k, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS phrase
            FROM (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM worded
                  WINDOW o AS (PARTITION BY id ORDER BY i))),
        f AS (SELECT lang, k, phrase, count(*) AS n FROM phrase WHERE phrase IS NOT NULL GROUP BY ALL),
        total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        candidate AS (SELECT lang, k AS len, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
        cut AS (SELECT *, unnest(range(1, len)) AS j FROM candidate),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.j, x.n AS l, y.n AS r,
                   (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
            FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = list_aggregate(c.w[1:c.j], 'string_agg', ' ')
                       JOIN f y ON y.lang = c.lang AND y.phrase = list_aggregate(c.w[c.j + 1:], 'string_agg', ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        inside AS (
            SELECT lang, a, list_aggregate(w[i:i + 1], 'string_agg', ' ') AS phrase
            FROM (SELECT *, unnest([1, 2]) AS i FROM candidate WHERE len = 3)),
        kept AS (
            SELECT * FROM best b WHERE NOT EXISTS (
                SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 50 * b.a))
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        JOIN total USING (lang) WHERE rank <= 2000
    """,
}
