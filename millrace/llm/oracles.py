"""SQL for those queries that SQL can express: plain formulations, in the dialect of the checker.

Packing, secrets and personal data have none (tokens, positions of matches); tests
hold those against brute force.
"""

from __future__ import annotations

from . import chat, licenses, mixing, quality_rules, topk

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{SPACES}'), lambda x: x != '')"


def license_scans() -> str:
    """Marks as the operator puts them, but each twice, so that a sentence can take one at either side for itself."""
    names = " ".join(f"WHEN {_text(t)} THEN {_text(name)}" for name, texts in licenses.SENTENCES.items() for t in texts)
    every = sorted((t for texts in licenses.SENTENCES.values() for t in texts), key=lambda t: (-len(t), t))
    sought = "[|_] (" + "|".join(t.replace(" ", "(?: _ _)? ") for t in every) + ") [|_]"
    marks = (
        (r"\r\n|\r", r"\n"),
        (r"[|_]", " "),
        (r"\n(?:[^a-z0-9\n]*\n)+", " | "),
        (r"(?:^|\n+)[^a-z0-9|\n]*(?:(?:rem|dnl)([\x20\t])|[0-9a-z]\))?", r"_\1"),
        (r"(gpl-[0-9]\.[0-9])\+", r"\1 or later "),
        (r"\bv\.([\x20\t_])", r"v_\1"),
        (r"[.!?;:]*[.!?][.!?;:]*([\x20\t_]|$)", r" | \1"),
        (r"[;:]+([\x20\t_]|$)", r"_\1"),
        (r"[^a-z0-9|_]+", " "),
        (r" *_[ _]*", " _ "),
        (r"(?: _)? \|(?: [|_])* ", " | "),
    )
    marked = "lower(coalesce(text, ''))"
    for pattern, put in marks:
        marked = f"regexp_replace({marked}, '{pattern}', {'chr(10)' if put == chr(92) + 'n' else _text(put)}, 'g')"
    steps, found, rest = [], [], "r0"
    for i, (name, ids) in enumerate(licenses.RULES, 1):
        sought_ids = _text("".join(f",{x}," for x in ids))
        found.append(f"CASE WHEN contains({rest}, {sought_ids}) THEN {_text(name)} END")
        steps.append(f"replace({rest}, {sought_ids}, '#') AS r{i}")
        rest = f"r{i}"
    return rf"""
    WITH marked AS (SELECT doc_id, regexp_replace('| ' || {marked} || ' |', ' +', ' ', 'g') AS m FROM documents),
    twice AS (SELECT doc_id, replace(replace(m, '|', '| |'), '_', '_ _') AS m FROM marked),
    plain AS (SELECT doc_id, list_transform(regexp_extract_all(m, '{sought}', 1), lambda x: replace(x, ' _ _', '')) AS s FROM twice),
    ids AS (SELECT doc_id, list_transform(s, lambda x: CASE x {names} END) AS ids FROM plain),
    rest AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS r0 FROM ids),
    steps AS (SELECT doc_id, ids, r0, {", ".join(steps)} FROM rest),
    hits AS (SELECT doc_id, ids, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS h FROM steps),
    once AS (SELECT doc_id, ids, list_filter(h, lambda x, i: list_position(h, x) = i) AS h FROM hits)
    SELECT doc_id, len(ids) AS n_license_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(h, ',') AS licenses, len(h) AS n_licenses FROM once"""


def quality() -> str:
    rules = quality_rules.Rules()
    classes = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": r"[^#*$%&|<>]+", "beyond": r"[\x00-\x7F]+", "other": r"[a-zA-Z0-9\x20\x09-\x0D#*$%&|<>\x{80}-\x{10FFFF}]+"}
    counts = ", ".join(f"length(regexp_replace(t, '{drop}', '', 'g')) AS c_{k}" for k, drop in classes.items())
    names = [f"c_{k}" for k in quality_rules.CLASSES]
    part = "(CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END)"
    term = f"{part.format('p', 'q')} + {part.format('q', 'p')}"
    class_pairs = " UNION ALL ".join(f"SELECT id, d.{c} / CAST(greatest(n_chars_text, 1) AS DOUBLE) AS p, r.{c} / CAST(greatest(r.total, 1) AS DOUBLE) AS q FROM d JOIN class_ref r USING (l)" for c in names)
    return rf"""
    WITH base AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '{quality_rules.NO_LANG[1:]}') AS l, coalesce(text, '') AS t, {_words("text")} AS w FROM documents),
    word AS (SELECT id, l, unnest(w) AS word FROM base),
    ranked AS (SELECT l, word, n, row_number() OVER (PARTITION BY l ORDER BY n DESC, word) AS r, sum(n) OVER (PARTITION BY l) AS total FROM (SELECT l, word, count(*) AS n FROM word GROUP BY 1, 2)),
    common AS (SELECT l, word, n / CAST(total AS DOUBLE) AS q FROM ranked WHERE r <= {rules.common}),
    windows AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)),
    again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, x) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS k FROM again) GROUP BY 1),
    line AS (SELECT id, x FROM (SELECT id, unnest(string_split(t, chr(10))) AS x FROM base) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
    dup AS (SELECT id, count(*) - count(DISTINCT x) AS n FROM line GROUP BY 1),
    c AS (SELECT id, doc_id, l, length(t) AS n_chars_text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {counts} FROM base),
    c2 AS (SELECT *, n_chars_text - word_chars AS c_space FROM c),
    d AS (SELECT *, n_chars_text - c_upper - c_digit - c_space - c_symbol - c_beyond - c_other AS c_lower FROM c2),
    class_ref AS (SELECT l, {", ".join(f"sum({n}) AS {n}" for n in names)}, {" + ".join(f"sum({n})" for n in names)} AS total FROM d GROUP BY 1),
    known AS (SELECT l, max(total) >= {rules.min_reference} AS known FROM ranked GROUP BY 1),
    class_js AS (SELECT id, sqrt(greatest(sum({term}) / 2, 0)) AS js FROM ({class_pairs}) GROUP BY 1),
    own AS (SELECT id, l, word, count(*) AS n FROM word JOIN common USING (l, word) GROUP BY 1, 2, 3),
    each AS (SELECT d.id, common.q, coalesce(own.n, 0) AS n, d.n_words FROM d JOIN common USING (l) LEFT JOIN own ON own.id = d.id AND own.word = common.word),
    word_pairs AS (SELECT id, n / CAST(greatest(n_words, 1) AS DOUBLE) AS p, q FROM each UNION ALL SELECT id, (n_words - sum(n)) / CAST(greatest(n_words, 1) AS DOUBLE), greatest(0, 1 - sum(q)) FROM each GROUP BY id, n_words),
    word_js AS (SELECT id, sqrt(greatest(sum({term}) / 2, 0)) AS js FROM word_pairs GROUP BY 1),
    out AS (SELECT d.doc_id, n_words, word_chars, c_symbol AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
      n_words < {rules.min_words_base} OR 100 * coalesce(covered.n, 0) > {rules.max_repeat_percent} * n_words AS base_failed,
      CASE WHEN known AND n_chars_text >= {rules.min_chars} THEN round(class_js.js, 5) END AS class_distance, CASE WHEN known AND n_words >= {rules.min_words} THEN round(word_js.js, 5) END AS word_distance
      FROM d LEFT JOIN known USING (l) LEFT JOIN dup USING (id) LEFT JOIN covered USING (id) LEFT JOIN class_js USING (id) LEFT JOIN word_js USING (id))
    SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {rules.max_class_distance} AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept FROM out"""


def near_dedup(size: int = 3, percent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
    WITH RECURSIVE base AS (SELECT row_number() OVER () AS id, doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
    sets AS (SELECT DISTINCT id, doc_id, {shingle} AS s FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM base WHERE len(w) >= {size})
      UNION ALL SELECT id, doc_id, array_to_string(w, ' ') FROM base WHERE len(w) BETWEEN 1 AND {size - 1}),
    sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY 1),
    common AS (SELECT a.id AS x, b.id AS y, min(a.doc_id) AS a, min(b.doc_id) AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.id != b.id AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY 1, 2),
    links AS (SELECT DISTINCT a, b FROM common JOIN sizes p ON x = p.id JOIN sizes q ON y = q.id WHERE 100 * common.n >= {percent} * (p.n + q.n - common.n)),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, least(doc_id, coalesce(least_of.b, doc_id)) AS component_id, coalesce(doc_id <= coalesce(least_of.b, doc_id), true) AS kept
    FROM base LEFT JOIN sizes USING (id) LEFT JOIN least_of ON doc_id = least_of.a"""


def source_mixing() -> str:
    weights = ", ".join(f"CAST({w} AS DOUBLE)" for w in mixing.WEIGHTS)
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len({_words("text")}) AS size FROM documents),
    q AS (SELECT doc_id, source, size, length(regexp_replace(t, '[\\x00-@\\[-`{{-\\x7F]+', '', 'g')) AS letters, length(regexp_replace(t, '{SPACES}', '', 'g')) AS solid, (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(t)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM d),
    p AS (SELECT *, solid / CAST(greatest(size, 1) AS DOUBLE) AS per_word FROM q),
    k AS (SELECT doc_id, source, size, -ln(u) / (0.25 + letters / CAST(greatest(solid, 1) AS DOUBLE) * exp(-greatest(3 - per_word, per_word - 9, 0) / 3) * (size / (size + 20.0::DOUBLE))) AS key FROM p),
    s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn FROM d GROUP BY 1),
    w AS (SELECT *, [{weights}][(turn - 1) % {len(mixing.WEIGHTS)} + 1] AS w, {mixing.EPOCH_LIMIT} * n AS cap FROM s),
    l AS (SELECT *, (sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    f AS (SELECT level FROM l WHERE level * w < cap ORDER BY cap / w, turn LIMIT 1),
    t AS (SELECT source, CAST(n AS BIGINT) AS source_size, round(least(cap, coalesce((SELECT level FROM f) * w, cap)), 6) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
    o AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, row_no) AS upto FROM (SELECT *, row_number() OVER (ORDER BY key, doc_id) AS row_no FROM k) k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN source_size > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o"""


def exact_topk() -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) WHERE rank <= {topk.K}"""


def chat_formatting(tricky: str) -> str:
    def escaped(text: str) -> str:
        out = rf"replace({text}, '\', '\\')"
        for control in chat.CONTROL:
            out = f"replace({out}, {_text(control)}, '##')"
        return out

    marks = " ".join(f"WHEN {_text(name)} THEN {len(r.before) + len(r.after)}" for name, r in chat.TEMPLATE.items())
    other = f"{len(chat.OTHER.before) + len(chat.NAME_END) + len(chat.OTHER.after)} + length({escaped('role')})"
    loss = ", ".join(_text(name) for name, r in chat.TEMPLATE.items() if r.loss)
    after = " ".join(f"WHEN {_text(last)} THEN role IN ({', '.join(map(_text, may))})" for last, may in chat.TRANSITIONS.items() if last is not None)
    first = ", ".join(map(_text, chat.TRANSITIONS[None]))
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_text(tricky)}), (-7, 1, 'assistant', {_text(tricky)})),
    n AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text)),
    f AS (SELECT *, CASE WHEN n = 1 THEN role IN ({first}) ELSE coalesce(CASE last {after} END, false) END AS ok, length({escaped('text')}) + CASE role {marks} ELSE {other} END AS chars FROM n)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role IN ({loss})), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AS in_order FROM f GROUP BY 1"""


def warc() -> str:
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {i}, 5) AS BIGINT) >> {shift}) & 31) + 1, 1)" for i in range(1, 41, 5) for shift in (15, 10, 5, 0))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
    SELECT page_id, strlen(html) AS payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first_id THEN first_id END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    from .queries import TRICKY

    return {
        "op1_license_scans": license_scans(),
        "op2_quality_rules": quality(),
        "op4_minhash_near_dedup": near_dedup(),
        "op5_source_mixing": source_mixing(),
        "op7_exact_topk": exact_topk(),
        "op9_chat_formatting": chat_formatting(TRICKY),
        "op10_warc": warc(),
    }
