"""Check statements for DuckDB."""

#: crc32 of a text's bytes: eight rounds make the table's entry of a byte, one step a byte of text.
_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

SHARDING = f"""
WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
raw AS (
    SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
),
sized AS (
    SELECT doc_id, source, n + 8 AS size,
        xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS text_crc32,
        ('0x' || substr(md5('shard:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS hash
    FROM raw, crc_table
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n
    FROM sized
),
placed AS (
    SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, hash, source, doc_id) - 1 AS p, count(*) OVER () AS total
    FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 24 // total)::INTEGER AS shard,
    p - ((p * 24 // total) * total + 23) // 24 AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
"""


def mixing(docs: str) -> str:
    """Rows of `docs` (a table with doc_id, text and source) with size, source_size, target, copies."""
    return f"""
WITH sized AS (
    SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS hash
    FROM {docs}
),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap
    FROM sums
),
filled AS (
    SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0) AS open_size,
        sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_weight
    FROM weighed
    WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
marked AS (SELECT *, cap * open_weight <= open_size * w AS is_full FROM filled),
targets AS (
    SELECT source, source_size,
        CASE WHEN is_full THEN cap ELSE
            ((sum(source_size) OVER ())::DOUBLE - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w
            / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target
    FROM marked
),
joined AS (
    SELECT sized.*, source_size, target,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
        (sum(size) OVER (PARTITION BY sized.source ORDER BY hash ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT *, whole + CASE
    WHEN source_size = 0 THEN 0
    WHEN upto + (upto - size) < 2 * (target - whole * source_size) THEN 1
    ELSE 0 END AS copies
FROM joined
"""


MIXING = f"SELECT doc_id, size, source_size, target, size * copies AS taken, source FROM ({mixing('documents')})"

TOP_K = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: SHA-1 in base32: twenty bits at a time make four characters.
WARC = """
WITH raw AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS bytes, sha1(payload) AS h, row_number() OVER () AS place FROM raw),
told AS (
    SELECT page_id, bytes,
        array_to_string(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS digest,
        row_number() OVER same AS r, first_value(page_id) OVER same AS first_page
    FROM hashed WINDOW same AS (PARTITION BY h, bytes ORDER BY page_id DESC NULLS LAST, place)
)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN r > 1 THEN first_page END AS refers_to, 'ok' AS status
FROM told
"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS place, {_TERMS} AS ts FROM documents),
sized AS (SELECT doc_id, place, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
asked AS (SELECT item_id, place, term, count(*)::BIGINT AS times FROM
    (SELECT item_id, row_number() OVER () AS place, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(ts) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), total),
added AS (SELECT held.place, held.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS value
    FROM held JOIN sized USING (place) JOIN weights USING (term), total),
scored AS (SELECT asked.item_id, asked.place AS item_place, added.place, sum(times * value)::BIGINT AS score
    FROM asked JOIN added USING (term) GROUP BY ALL HAVING sum(times * value) > 0),
ranked AS (SELECT item_id, doc_id, score,
    (row_number() OVER (PARTITION BY item_place ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
    FROM scored JOIN sized USING (place))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
