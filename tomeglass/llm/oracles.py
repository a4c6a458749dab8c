"""SQL of the text-preparation queries for a second engine, as far as SQL can state them."""

from __future__ import annotations

from tomeglass.llm.license_rules import IDENTIFIER, RULES, in_order
from tomeglass.llm.line_rules import Limits as LineLimits
from tomeglass.llm.queries import URL_RULES
from tomeglass.llm.resampling import Draw
from tomeglass.llm.url_filter import Limits as UrlLimits

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_templates(limits: UrlLimits = UrlLimits(), d: int = 6) -> str:
    """The tree unrolled to ``d`` levels, more than a given path has."""
    rules = sorted(URL_RULES, key=lambda r: -len(r[0]))
    fits = [
        (f"(host = {_text(r.partition('/')[0])} OR ends_with(host, {_text('.' + r.partition('/')[0])})) AND starts_with(path, {_text('/' + r.partition('/')[2])})", r, v)
        for r, v in rules
    ]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {_text(r)}" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN {_text(v)}" for f, _, v in fits) + " END"
    parts = [
        "bads AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id)",
        r"""after AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
            regexp_extract(url, '^[^:]*://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})[^/?#]*/?(?:[?#]|$)', 1) AS number FROM pages)""",
        rf"""parsed AS (SELECT page_id, number, translate(regexp_extract(rest, '^[^/?#]*'), {LETTERS}) AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after)""",
        "cut AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS whole FROM parsed)",
        """l0 AS (SELECT page_id, host, path, bad, '' AS template, whole AS segs
            FROM cut LEFT JOIN bads ON bads.doc_id = CASE WHEN number <> '' THEN CAST(number AS BIGINT) END)""",
    ]
    for i in range(d):
        parts += [
            f"""b{i} AS (SELECT host, template, segs[{i + 1}] AS segment, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bads
                FROM l{i} WHERE len(segs) > {i} GROUP BY ALL)""",
            f"p{i} AS (SELECT host, template, sum(n) AS all_n, sum(known) AS all_known, sum(bads) AS all_bad FROM b{i} GROUP BY ALL)",
            f"""h{i} AS (SELECT b.*, (all_bad + 0.5::DOUBLE) / (all_known + 1) AS share FROM b{i} b JOIN p{i} USING (host, template)
                WHERE n >= {limits.support} AND n * {limits.fanout} >= all_n)""",
            f"a{i} AS (SELECT *, abs(bads - known * share) <= {limits.similar} * sqrt(known * share * (1 - share)) AS alike FROM h{i})",
            f"""n{i} AS (SELECT host, template, segment, CASE WHEN alike AND sum(CASE WHEN alike THEN 1 ELSE 0 END) OVER (PARTITION BY host, template) > 1
                THEN '+' ELSE segment END AS name FROM a{i})""",
            f"""l{i + 1} AS (SELECT page_id, l.host, path, bad, segs, CASE WHEN len(segs) > {i} THEN l.template || '/' ||
                coalesce(name, '*' || regexp_extract(segs[{i + 1}], '(\\.[A-Za-z]{{1,5}})$', 1)) ELSE l.template END AS template
                FROM l{i} l LEFT JOIN n{i} n ON n.host = l.host AND n.template = l.template AND n.segment = l.segs[{i + 1}])""",
        ]
    return f"""WITH {", ".join(parts)},
        good AS (SELECT 1 - coalesce(sum(bad), 0)::DOUBLE / greatest(count(bad), 1) AS good FROM l0),
        impure AS (SELECT host, template FROM l{d} GROUP BY host, template
            HAVING (count(bad) - coalesce(sum(bad), 0) + {limits.weight} * (SELECT good FROM good)) / (count(bad) + {limits.weight}) < {limits.purity})
        SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN impure.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict, template
        FROM l{d} LEFT JOIN impure USING (host, template)"""


def license_rules() -> str:
    known = "MAP {" + ", ".join(f"{_text(s)}: {_text(i)}" for s, i in IDENTIFIER.items()) + "}"
    families = []
    for _, rules in RULES:
        tests = " ".join(f"WHEN regexp_matches(line, {_text(in_order(needed))}) THEN {_text(name)}" for name, needed in rules)
        families.append(f"CASE {tests} END")
    return rf"""
        WITH s AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\n|[.!?:;]+[ \t\r\n]'),
                lambda x: trim(regexp_replace(translate(x, {LETTERS}), '[^a-z0-9]+', ' ', 'g'))) AS s FROM documents),
        known AS (SELECT {known} AS names),
        f AS (SELECT doc_id, list_filter(list_transform(s, lambda x: names[x]), lambda x: x IS NOT NULL) AS ids FROM s, known),
        l AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM f)
        SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
            array_to_string(list_filter([{", ".join(families)}], lambda x: x IS NOT NULL), ',') AS licenses FROM l"""


def line_frequency(limits: LineLimits = LineLimits()) -> str:
    space = r"[ \t\x0B\f\r]+"
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
        w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS words FROM d),
        p AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w),
        g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS run FROM p),
        twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
        covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
        raw_lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
        lines AS (SELECT r, source, k, line, lower(trim(regexp_replace(line, '{space}', ' ', 'g'), ' ')) AS norm,
            len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS n FROM raw_lines WHERE regexp_matches(line, '[^ \t\x0B\f\r]')),
        dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
        told AS (SELECT r, source, list(norm ORDER BY k) AS told FROM lines GROUP BY r, source),
        sizes AS (SELECT source, count(DISTINCT told) AS docs FROM told GROUP BY source),
        counted AS (SELECT l.source, l.norm, count(DISTINCT told) AS n FROM lines l JOIN told USING (r) GROUP BY ALL),
        frequent AS (SELECT c.source, norm FROM counted c JOIN sizes s USING (source) WHERE n > {limits.min_docs} AND n > {limits.share} * docs),
        gone AS (SELECT r, sum(l.n) AS n FROM lines l JOIN frequent f USING (source, norm) GROUP BY r),
        base AS (SELECT r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
            coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
            FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)),
        judged AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeated} * n_words AS base_failed FROM base)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
            n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= {limits.left} * n_words AS kept FROM judged"""


def containment(percent: int = 80) -> str:
    words = "regexp_extract_all(translate(text, " + LETTERS + "), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    run = "words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4]"
    return rf"""
        WITH iw AS (SELECT item_id, {words} AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        im AS (SELECT DISTINCT item_id, {run} AS run FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS i FROM iw)
            UNION SELECT item_id, array_to_string(words, ' ') FROM iw WHERE len(words) BETWEEN 1 AND 4),
        dw AS (SELECT doc_id, {words} AS words FROM documents WHERE text IS NOT NULL),
        dr AS (SELECT DISTINCT doc_id, {run} AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM dw)),
        sizes AS (SELECT item_id, count(*) AS n_item FROM im GROUP BY item_id),
        shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dr JOIN im USING (run) GROUP BY ALL)
        SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM shared JOIN sizes USING (item_id)
        WHERE 100 * n_shared >= {percent} * n_item"""


def near_copies(percent: int = 80) -> str:
    """Links from pairs that share one of their rarest shingles, of which linked texts must share one."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORD}') AS words FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] AS run FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)
            UNION SELECT doc_id, words[1] FROM w WHERE len(words) = 1),
        sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        rare AS (SELECT run, count(*) AS df FROM s GROUP BY run),
        ranked AS (SELECT doc_id, run, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, run) AS k FROM s JOIN rare USING (run) JOIN sizes USING (doc_id)),
        prefix AS MATERIALIZED (SELECT doc_id, run, n FROM ranked WHERE k <= n - (n * {percent} + 99) // 100 + 1),
        pairs AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.run = b.run AND a.doc_id < b.doc_id
            WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
        shared AS (SELECT p.a, p.b, na, nb, count(*) AS inter FROM pairs p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.run = x.run GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * inter >= {percent} * (na + nb - inter)),
        ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
        least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(b, w.doc_id)) AS kept
        FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


def _crc32(text: str) -> str:
    """The CRC of the UTF-8 bytes of ``text``, with ``crc_table.t`` in the FROM clause."""
    byte = f"CAST('0x' || substr(hex({text}), 2 * k + 1, 2) AS BIGINT)"
    data = f"list_transform(range(0, len(hex({text})) // 2), lambda k: {byte})"
    step = "xor(c >> 8, crc_table.t[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295::BIGINT)"


CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def role_repair() -> str:
    """Rows one by one over the four places in the role order, each with its cheapest way: cost, letters, repaired rows."""
    space = r"\x20\x09-\x0D"

    def edited(way: str, cost: str, letter: str, line: str = "") -> str:
        out = f"{way}.o || {line} || chr(10)" if line else f"{way}.o"
        return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 'o': {out}}} END"

    def deleted(way: str) -> str:
        return edited(way, "3", "D")

    def kept(way: str, initial: str) -> str:
        return f"CASE WHEN NOT bad AND left(role, 1) = '{initial}' THEN {edited(way, 'late', 'K', 'role || chr(58) || text')} END"

    def reroled(way: str, role: str) -> str:
        line = f"'{role}:' || text"
        return f"CASE WHEN NOT bad THEN {edited(way, '2 + late', 'R', line)} END"

    def inserted(way: str, role: str) -> str:
        return edited(way, "2", "I", f"'{role}:'")

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"

    at_user = [f(w, x) for w in ("p0", "p1", "p3") for f, x in ((kept, "u"), (reroled, "user"))]
    return rf"""
        WITH RECURSIVE {CRC_TABLE},
        ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
        plain AS (SELECT ids.c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations v JOIN ids ON v.conv_id IS NOT DISTINCT FROM ids.conv_id),
        kinds AS (SELECT c, turn, role, text, {_crc32("key")} % 20 AS kind FROM plain, crc_table),
        harmed AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
        seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS n FROM harmed),
        judged AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), n) AS pos,
            CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN n > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][{space}]*\z') THEN 'truncated' END AS fault FROM seen),
        rows AS MATERIALIZED (SELECT c, pos, turn, role, text, fault, coalesce(fault IN ('blank', 'duplicate'), false) AS bad,
            CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late,
            coalesce(left(lag(role) OVER (PARTITION BY c ORDER BY pos), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd FROM judged),
        walk AS (SELECT c, 0::BIGINT AS pos, {{'c': 0, 'a': '', 'o': ''}} AS p0, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR) AS p1,
                {{'c': 2, 'a': 'I', 'o': 'user:' || chr(10)}} AS p2, {{'c': 4, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS p3 FROM ids
            UNION ALL SELECT c, pos, q0, q1, r2, {least("q3", inserted("r2", "assistant"))} FROM
                (SELECT *, {least("q2", inserted("q0", "user"), inserted("q1", "user"), inserted("q3", "user"))} AS r2 FROM
                    (SELECT walk.c, rows.pos, {deleted("p0")} AS q0, {least(deleted("p1"), kept("p0", "s"))} AS q1,
                        {least(deleted("p2"), *at_user)} AS q2, {least(deleted("p3"), kept("p2", "a"), reroled("p2", "assistant"))} AS q3
                        FROM walk JOIN rows ON rows.c = walk.c AND rows.pos = walk.pos + 1))),
        sums AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM rows GROUP BY c),
        ends AS (SELECT walk.c, {least("p0", "p3")} AS way FROM walk JOIN sums ON sums.c = walk.c AND sums.n = walk.pos)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit,
            sha256(regexp_replace(coalesce(way.o, ''), '\n\z', '')) AS repaired_sha256
        FROM ids LEFT JOIN sums USING (c) LEFT JOIN ends USING (c)"""


def target_draw(how: Draw = Draw()) -> str:
    assert how.order == 2
    words = f"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS run"
    return rf"""
        WITH {CRC_TABLE},
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        f AS MATERIALIZED (SELECT r, run, count(*) AS n FROM (SELECT r, {runs} FROM d) GROUP BY ALL),
        g AS MATERIALIZED (SELECT run, count(*) AS n FROM (SELECT {runs} FROM (SELECT {words} AS w FROM benchmark)) GROUP BY ALL),
        coded AS MATERIALIZED (SELECT run, {_crc32("run")} % {how.buckets} AS bucket FROM (SELECT run FROM f UNION SELECT run FROM g), crc_table),
        s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM f JOIN coded USING (run) GROUP BY bucket),
        t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM g JOIN coded USING (run) GROUP BY bucket),
        sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + {how.buckets} AS s_all, coalesce((SELECT sum(t) FROM t), 0) + {how.buckets} AS t_all),
        gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * s_all / ((s + 1) * t_all)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
        weights AS (SELECT r, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)) AS weight FROM f JOIN coded USING (run) JOIN gain USING (bucket) GROUP BY r),
        noise AS (SELECT r, CAST('0x' || substr(sha256('{how.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d),
        scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d JOIN noise USING (r) LEFT JOIN weights USING (r)),
        able AS (SELECT *, n_words >= {how.least_words} AS able FROM scored),
        placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
            {how.percent} * count(*) OVER (PARTITION BY able) // 100 AS drawn FROM able)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM placed"""


LLM_ORACLES: dict[str, str] = {
    "op1_url_templates": url_templates(),
    "op2_license_rules": license_rules(),
    "op4_line_frequency": line_frequency(),
    "op9_containment": containment(),
    "op10_near_copies": near_copies(),
    "op12_role_repair": role_repair(),
    "op13_target_draw": target_draw(),
}
