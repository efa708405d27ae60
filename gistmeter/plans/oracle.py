"""The same results as portable SQL, built from named common table expressions.

Each fragment names the fragments it reads; `sql` collects what a query needs.  `p` is the
pair table a query is asked for.
"""

import re

WORD = r"[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
KEY = "('0x' || substr(md5(tok), 1, 8))::BIGINT % (SELECT n FROM nv)"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def sentences(x: str) -> str:
    return (rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), "
            r"lambda s: regexp_matches(s, '\S'))")


def ascii_words(x: str) -> str:
    return (rf"list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), "
            r"lambda w: regexp_matches(w, '^[A-Za-z]+$'))")


def r6(x: str, name: str) -> str:
    return f'round({x}, 6) + 0.0 AS "{name}"'


FRAGMENTS: dict[str, str] = {}
FRAGMENTS["pairs_doc"] = f"""
SELECT doc_id AS id, text, array_to_string(list_concat(sents[1:2], [lead(sents[1]) OVER w]), ' ') AS summary
FROM (SELECT doc_id, lang, text, {sentences('text')} AS sents FROM documents)
WINDOW w AS (PARTITION BY lang ORDER BY doc_id)"""
FRAGMENTS["pairs_conv"] = """
SELECT a.conv_id * 1000 + a.turn AS id, a.text AS text, b.text AS summary
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
WHERE a.role = 'assistant' AND b.role = 'user'"""
FRAGMENTS["human"] = "SELECT doc_id AS id, quality::DOUBLE AS overall_score_human FROM labels"
FRAGMENTS["tok"] = f"""
SELECT id, 0 AS side, unnest({words('text')}) AS tok, generate_subscripts({words('text')}, 1) AS pos FROM p
UNION ALL
SELECT id, 1, unnest({words('summary')}), generate_subscripts({words('summary')}, 1) FROM p"""
FRAGMENTS["sen"] = f"""
SELECT id, 0 AS side, unnest({sentences('text')}) AS sent, generate_subscripts({sentences('text')}, 1) - 1 AS sp FROM p
UNION ALL
SELECT id, 1, unnest({sentences('summary')}), generate_subscripts({sentences('summary')}, 1) - 1 FROM p"""
FRAGMENTS["stok"] = f"""
SELECT id, side, sp, unnest({words('sent')}) AS tok, generate_subscripts({words('sent')}, 1) AS pos FROM sen"""
# --- trigram model
FRAGMENTS["tri"] = """
SELECT id, side, pos, coalesce(lag(tok, 2) OVER w, '<s>') AS w1, coalesce(lag(tok, 1) OVER w, '<s>') AS w2, tok AS w3
FROM tok WINDOW w AS (PARTITION BY id, side ORDER BY pos)"""
FRAGMENTS["trimodel"] = """
SELECT id, w1, w2, w3, count(*) AS c FROM tri WHERE side = 0 GROUP BY ALL"""
FRAGMENTS["trictx"] = "SELECT id, w1, w2, sum(c)::BIGINT AS c FROM trimodel GROUP BY ALL"
FRAGMENTS["vocab"] = "SELECT id, count(DISTINCT tok) AS v FROM tok WHERE side = 0 GROUP BY id"
FRAGMENTS["triprob"] = """
SELECT t.id, t.pos, t.w1, t.w2, t.w3, (coalesce(m.c, 0) + 1)::DOUBLE / nullif(coalesce(x.c, 0) + v.v, 0) AS p
FROM tri t JOIN vocab v USING (id)
LEFT JOIN trimodel m ON m.id = t.id AND m.w1 = t.w1 AND m.w2 = t.w2 AND m.w3 = t.w3
LEFT JOIN trictx x ON x.id = t.id AND x.w1 = t.w1 AND x.w2 = t.w2
WHERE t.side = 1"""
FRAGMENTS["perplexity"] = """
SELECT p.id, exp(-avg(ln(q.p))) AS perplexity FROM p LEFT JOIN triprob q USING (id) GROUP BY p.id"""
# --- word distribution
FRAGMENTS["uni"] = """
SELECT id, tok, count(*) FILTER (side = 0) AS cd, count(*) FILTER (side = 1) AS cs FROM tok GROUP BY id, tok"""
FRAGMENTS["xy"] = """
SELECT id, tok, cd, cd::DOUBLE / sum(cd) OVER w AS x, (cd + cs)::DOUBLE / sum(cd + cs) OVER w AS y
FROM uni WINDOW w AS (PARTITION BY id)"""
FRAGMENTS["xymean"] = """
SELECT id, sum(cd)::DOUBLE AS n, sum(cd * x) / sum(cd) AS mx, sum(cd * y) / sum(cd) AS my,
       sum(cd * abs(y - x)) AS w, min(x) AS nx, max(x) AS gx, min(y) AS ny, max(y) AS gy
FROM xy WHERE cd > 0 GROUP BY id"""
FRAGMENTS["sdc"] = """
SELECT id, w AS sdc_shift, c AS sdc_correlation, w * (c + 1) / 2 AS sdc_unigram FROM (
  SELECT m.id, CASE WHEN m.n >= 2 THEN m.w END AS w,
         CASE WHEN m.n < 2 THEN NULL WHEN nx = gx OR ny = gy THEN 0.0
              ELSE sum(cd * (x - mx) * (y - my)) / sqrt(sum(cd * (x - mx) * (x - mx)) * sum(cd * (y - my) * (y - my))) END AS c
  FROM xymean m JOIN xy USING (id) WHERE cd > 0 GROUP BY m.id, m.n, m.w, nx, gx, ny, gy)"""
# --- bigram surprisal
FRAGMENTS["big"] = """
SELECT id, sp, pos, coalesce(lag(tok) OVER w, '<unk>') AS c, tok AS w FROM stok WHERE side = 0
  WINDOW w AS (PARTITION BY id, sp ORDER BY pos)
UNION ALL
SELECT id, sp, NULL, arg_max(tok, pos), '<unk>' FROM stok WHERE side = 0 GROUP BY id, sp"""
FRAGMENTS["bigc"] = "SELECT id, c, w, count(*) AS n FROM big GROUP BY ALL"
FRAGMENTS["bctx"] = "SELECT id, c, sum(n)::BIGINT AS n, count(*) AS types FROM bigc GROUP BY ALL"
FRAGMENTS["bpre"] = "SELECT id, w, count(*) AS preds FROM bigc GROUP BY ALL"
FRAGMENTS["btyp"] = "SELECT id, count(*) AS types FROM bigc GROUP BY ALL"
FRAGMENTS["tail"] = """
SELECT s.id, CASE WHEN EXISTS (SELECT 1 FROM bpre b WHERE b.id = s.id AND b.w = s.t) THEN s.t ELSE '<unk>' END AS t
FROM (SELECT id, arg_max(tok, sp * 10000000 + pos) AS t FROM stok WHERE side = 1 GROUP BY id) s"""
FRAGMENTS["lastsp"] = "SELECT id, max(sp) AS m FROM sen WHERE side = 0 GROUP BY id"
FRAGMENTS["prior"] = """
SELECT s.id, arg_max(tok, s.sp * 10000000 + pos) AS t FROM stok s JOIN lastsp l USING (id)
WHERE side = 0 AND s.sp < l.m GROUP BY s.id"""
FRAGMENTS["targets"] = """
SELECT id, 'd' AS kind, c, w FROM big WHERE pos IS NOT NULL
UNION ALL
SELECT b.id, 'ds', CASE WHEN b.pos = 1 THEN coalesce(t.t, '<unk>') ELSE b.c END, b.w
FROM big b LEFT JOIN tail t USING (id) WHERE pos IS NOT NULL
UNION ALL
SELECT b.id, 'dd', CASE WHEN b.pos = 1 THEN r.t ELSE b.c END, b.w
FROM big b JOIN lastsp l ON l.id = b.id AND l.m = b.sp AND l.m > 0 JOIN prior r ON r.id = b.id WHERE pos IS NOT NULL"""
FRAGMENTS["knp"] = """
SELECT t.id, t.kind, t.c, t.w, CASE WHEN x.n IS NULL THEN q.preds::DOUBLE / y.types
  ELSE greatest(coalesce(b.n, 0) - 0.1::DOUBLE, 0) / x.n + 0.1::DOUBLE * x.types / x.n * q.preds / y.types END AS p
FROM targets t JOIN btyp y ON y.id = t.id JOIN bpre q ON q.id = t.id AND q.w = t.w
LEFT JOIN bctx x ON x.id = t.id AND x.c = t.c
LEFT JOIN bigc b ON b.id = t.id AND b.c = t.c AND b.w = t.w"""
FRAGMENTS["surprisal"] = """
SELECT id, coalesce(sum(greatest(-log2(p), 0)) FILTER (kind = 'd'), 0) AS i_d,
       coalesce(sum(greatest(-log2(p), 0)) FILTER (kind = 'ds'), 0) AS i_ds,
       coalesce(sum(greatest(-log2(p), 0)) FILTER (kind = 'dd'), 0) AS i_dd FROM knp GROUP BY id"""
FRAGMENTS["gained"] = """
SELECT id, sum(d * greatest(-log2(p), 0)) AS gain FROM (
  SELECT id, c, w, any_value(p) AS p, count(*) FILTER (kind = 'd') - count(*) FILTER (kind = 'ds') AS d FROM knp GROUP BY id, c, w)
WHERE d <> 0 GROUP BY id"""
FRAGMENTS["shannon"] = """
SELECT id, i_d, i_ds, i_dd, CASE WHEN i_d - i_dd > 0 THEN greatest(coalesce(gain, 0), 0) / (i_d - i_dd) ELSE 0.0 END AS shannon_score
FROM surprisal LEFT JOIN gained USING (id)"""
# --- readability and findings
FRAGMENTS["aword"] = f"SELECT id, unnest({ascii_words('summary')}) AS word FROM p"
FRAGMENTS["fcount"] = r"""
SELECT p.id, count(word) AS n_words,
       coalesce(sum(greatest(1, len(regexp_extract_all(lower(word), '[aeiouy]+')))) FILTER (word IS NOT NULL), 0)::BIGINT AS n_syllables
FROM p LEFT JOIN aword USING (id) GROUP BY p.id"""
EASE = """CASE WHEN n_words = 0 THEN 0.0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * (n_words::DOUBLE / nullif({unit}, 0))
  - 84.6::DOUBLE * (n_syllables::DOUBLE / nullif(n_words, 0)) END"""
FRAGMENTS["flesch"] = f"SELECT id, n_words, n_syllables, {EASE.format(unit='n_syllables')} AS flesch_score FROM fcount"
FRAGMENTS["flesch_std"] = f"""
SELECT id, n_words, n_syllables, n_sentences, {EASE.format(unit='n_sentences')} AS flesch_standard
FROM fcount JOIN (SELECT id, len({sentences('summary')}) AS n_sentences FROM p) USING (id)"""
FRAGMENTS["lexc"] = r"""
SELECT tok FROM tok WHERE side = 0 AND regexp_matches(tok, '^[\p{L}\p{N}]') GROUP BY tok HAVING count(DISTINCT id) >= 2"""
FRAGMENTS["nexttok"] = """
SELECT id, tok, lead(tok) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM tok WHERE side = 1"""
FRAGMENTS["findings"] = rf"""
SELECT * FROM (
  SELECT id, 'doubled_word' AS rule, count(*) AS n FROM nexttok
  WHERE tok = nxt AND regexp_matches(tok, '^[\p{{L}}\p{{N}}]') GROUP BY id
  UNION ALL
  SELECT id, 'article_mismatch', count(*) FROM nexttok WHERE (tok = 'a' AND regexp_matches(nxt, '^[aeiou]'))
     OR (tok = 'an' AND regexp_matches(nxt, '^[b-df-hj-np-tv-z]')) GROUP BY id
  UNION ALL
  SELECT id, 'lower_case_start', count(*) FROM sen WHERE side = 1 AND regexp_matches(sent, '^\s*\p{{Ll}}') GROUP BY id
  UNION ALL
  SELECT id, 'blank_before_punctuation', len(regexp_extract_all(summary, ' [,.;:!?]')) FROM p
  UNION ALL
  SELECT id, 'double_blank', len(regexp_extract_all(summary, ' {{2,}}')) FROM p
  UNION ALL
  SELECT id, 'double_punctuation',
         len(regexp_extract_all(summary, ',{{2,}}|;{{2,}}|:{{2,}}|!{{2,}}|\?{{2,}}|\.{{2,}}')) FROM p
  UNION ALL
  SELECT id, 'unknown_word', count(*) FROM tok WHERE side = 1 AND regexp_matches(tok, '^[\p{{L}}\p{{N}}]')
     AND tok NOT IN (SELECT tok FROM lexc) GROUP BY id) WHERE n > 0"""
FRAGMENTS["grammar"] = f"""
SELECT p.id, coalesce(f.n, 0)::BIGINT AS n_findings,
       coalesce(f.n, 0)::DOUBLE / greatest(len({ascii_words('p.summary')}), 1) AS grammar_score
FROM p LEFT JOIN (SELECT id, sum(n) AS n FROM findings GROUP BY id) f USING (id)"""
# --- vectors
FRAGMENTS["nv"] = "SELECT count(*) AS n FROM embeddings"
FRAGMENTS["tkey"] = f"SELECT id, side, {KEY} AS key, count(*) AS c FROM tok GROUP BY ALL"
FRAGMENTS["dims"] = """
SELECT vec_id AS key, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings"""
FRAGMENTS["tvec"] = """
SELECT id, side, k, sum(c * v) / sum(c) AS v FROM tkey JOIN dims USING (key) GROUP BY id, side, k"""
FRAGMENTS["embed"] = """
SELECT a.id, sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)), 0) AS embedding_similarity
FROM tvec a JOIN tvec b ON a.id = b.id AND a.k = b.k AND a.side = 0 AND b.side = 1 GROUP BY a.id"""
FRAGMENTS["vcos"] = """
SELECT a.vec_id AS s, b.vec_id AS t, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cs
FROM embeddings a, embeddings b"""
FRAGMENTS["vmatch"] = """
SELECT a.id, a.key AS s, a.c AS sc, b.key AS t, b.c AS tc, cs FROM tkey a JOIN tkey b ON a.id = b.id AND a.side = 1 AND b.side = 0
JOIN vcos ON vcos.s = a.key AND vcos.t = b.key"""
FRAGMENTS["bert"] = """
SELECT id, p AS "BERT Precision", r AS "BERT Recall", coalesce(2 * p * r / nullif(p + r, 0), 0) AS "BERT F1" FROM
  (SELECT id, sum(m * c) / sum(c) AS p FROM (SELECT id, s, max(cs) AS m, any_value(sc) AS c FROM vmatch GROUP BY id, s) GROUP BY id)
JOIN
  (SELECT id, sum(m * c) / sum(c) AS r FROM (SELECT id, t, max(cs) AS m, any_value(tc) AS c FROM vmatch GROUP BY id, t) GROUP BY id)
USING (id)"""
# --- pseudo-references in whole numbers; rounds beyond the last change make no difference
ROUNDS = 16
FRAGMENTS["idims"] = "SELECT key, k, floor(v * 1000)::BIGINT AS v FROM dims"
FRAGMENTS["sv"] = f"""
SELECT id, side, sp, k, floor(sum(c * v)::DOUBLE / sum(c))::BIGINT AS v
FROM (SELECT id, side, sp, {KEY} AS key, count(*) AS c FROM stok GROUP BY ALL) JOIN idims USING (key) GROUP BY id, side, sp, k"""
FRAGMENTS["km"] = """
SELECT id, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS k, count(*) FILTER (side = 0) AS m FROM sen GROUP BY id"""
FRAGMENTS["cen0"] = """
SELECT sv.id, c.i AS cl, sv.k, sv.v FROM (SELECT id, m, k, unnest(range(k)) AS i FROM km) c
JOIN sv ON sv.id = c.id AND sv.side = 0 AND sv.sp = (c.i * c.m) // c.k"""
for t in range(1, ROUNDS + 1):
    FRAGMENTS[f"asg{t}"] = f"""
SELECT id, sp, cl, d FROM (SELECT s.id, s.sp, c.cl, sum((s.v - c.v) * (s.v - c.v))::BIGINT AS d
  FROM sv s JOIN cen{t - 1} c ON c.id = s.id AND c.k = s.k AND s.side = 0 GROUP BY s.id, s.sp, c.cl)
QUALIFY row_number() OVER (PARTITION BY id, sp ORDER BY d, cl) = 1"""
    FRAGMENTS[f"cen{t}"] = f"""
SELECT a.id, a.cl, s.k, floor(sum(s.v)::DOUBLE / count(*))::BIGINT AS v
FROM asg{t} a JOIN sv s ON s.id = a.id AND s.sp = a.sp AND s.side = 0 GROUP BY a.id, a.cl, s.k"""
FRAGMENTS["refs"] = f"""
SELECT id, cl AS cluster, sp AS sent_pos FROM (
  SELECT a.id, a.cl, a.sp, sum((s.v - c.v) * (s.v - c.v)) AS d FROM asg{ROUNDS} a JOIN sv s ON s.id = a.id AND s.sp = a.sp AND s.side = 0
  JOIN cen{ROUNDS} c ON c.id = a.id AND c.cl = a.cl AND c.k = s.k GROUP BY a.id, a.cl, a.sp)
QUALIFY row_number() OVER (PARTITION BY id, cl ORDER BY d, sp) = 1"""
FRAGMENTS["supert"] = """
SELECT p.id, coalesce(q.score, 0) AS supert_score FROM p LEFT JOIN (
  SELECT id, avg(best) AS score FROM (SELECT id, sp, max(cs) AS best FROM (
    SELECT a.id, a.sp, r.sent_pos, sum(a.v * b.v)::DOUBLE / (sqrt(sum(a.v * a.v)::DOUBLE) * sqrt(sum(b.v * b.v)::DOUBLE)) AS cs
    FROM sv a JOIN refs r ON r.id = a.id AND a.side = 1 JOIN sv b ON b.id = r.id AND b.sp = r.sent_pos AND b.side = 0 AND b.k = a.k
    GROUP BY a.id, a.sp, r.sent_pos) GROUP BY id, sp) GROUP BY id) q USING (id)"""
# --- overlap
FRAGMENTS["raw_rtok"] = """
SELECT id, 0 AS side, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS raw,
       generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM p
UNION ALL
SELECT id, 1, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+')),
       generate_subscripts(regexp_extract_all(lower(summary), '[a-z0-9]+'), 1) FROM p"""
FRAGMENTS["rtok"] = "SELECT id, side, pos, stem AS tok FROM raw_rtok JOIN stems ON stems.tok = raw"


def prf(hits: str, s: str, t: str, name: str) -> str:
    p, r = f"coalesce(({hits})::DOUBLE / nullif({s}, 0), 0)", f"coalesce(({hits})::DOUBLE / nullif({t}, 0), 0)"
    return f'coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) AS "{name} F1", {r} AS "{name} Recall", {p} AS "{name} Precision"'


def _rouge(n: int) -> str:
    gram = "tok" if n == 1 else "CASE WHEN lag(tok) OVER w IS NOT NULL THEN lag(tok) OVER w || ' ' || tok END"
    window = "" if n == 1 else " WINDOW w AS (PARTITION BY id, side ORDER BY pos)"
    return f"""
SELECT p.id, {prf('coalesce(h, 0)', 's', 't', f'ROUGE-{n}')} FROM p LEFT JOIN (
  SELECT id, sum(least(a, b)) AS h, sum(b) AS s, sum(a) AS t FROM (
    SELECT id, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b
    FROM (SELECT id, side, {gram} AS g FROM rtok{window}) WHERE g IS NOT NULL GROUP BY id, g) GROUP BY id) USING (id)"""


FRAGMENTS["rouge1"], FRAGMENTS["rouge2"] = _rouge(1), _rouge(2)
FRAGMENTS["lcs_s"] = "SELECT id, pos AS i, tok FROM rtok WHERE side = 1"
FRAGMENTS["lcs_t"] = "SELECT id, pos AS j, tok FROM rtok WHERE side = 0"
FRAGMENTS["lcs"] = """
SELECT id, i, j, l FROM (SELECT id, 0 AS i, j, 0 AS l FROM lcs_t)
UNION ALL
SELECT id, i, j, max(cand) OVER (PARTITION BY id ORDER BY j) FROM (
  SELECT r.id, r.i + 1 AS i, r.j,
         greatest(r.l, CASE WHEN t.tok = s.tok THEN coalesce(lag(r.l) OVER (PARTITION BY r.id ORDER BY r.j), 0) + 1 ELSE 0 END) AS cand
  FROM lcs r JOIN lcs_s s ON s.id = r.id AND s.i = r.i + 1 JOIN lcs_t t ON t.id = r.id AND t.j = r.j)"""
FRAGMENTS["rougel"] = f"""
SELECT p.id, coalesce(h, 0)::BIGINT AS lcs, {prf('coalesce(h, 0)', 's', 't', 'ROUGE-L')} FROM p
LEFT JOIN (SELECT id, max(l) AS h FROM lcs GROUP BY id) USING (id)
LEFT JOIN (SELECT id, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 0) AS t FROM rtok GROUP BY id) USING (id)"""


def sql(final: str, pairs: str | None = None, **extra: str) -> str:
    """WITH clause for everything `final` reads, in order, then `final`."""
    fragments = {**FRAGMENTS, **extra}
    if pairs:
        fragments["p"] = f"SELECT * FROM {pairs}"
    done: list[str] = []

    def visit(body: str, path: tuple):
        held = set(re.findall(r"\w+", body))
        for name in fragments:
            if name not in held or name in path or name in done:
                continue
            if re.search(rf"(?<![\w.']){name}(?![\w'(])", body) and re.search(rf"(FROM|JOIN|,)\s+{name}\b", body):
                visit(fragments[name], path + (name,))
                done.append(name)

    visit(final, ())
    ctes = ",\n".join(f"{n} AS ({fragments[n]})" for n in done)
    return f"WITH RECURSIVE {ctes}\n{final}" if ctes else final


def _suffix_case(rules: list[tuple[str, str, str]], w: str = "w") -> str:
    """CASE over (suffix, condition with {s} for the stem, ending)."""
    out = []
    for suffix, holds, ending in rules:
        stem = f"left({w}, length({w}) - {len(suffix)})"
        out.append(f"WHEN suffix({w}, '{suffix}') THEN CASE WHEN {holds.format(s=stem)} THEN {stem} || '{ending}' ELSE {w} END")
    return "CASE " + " ".join(out) + f" ELSE {w} END"


def _stem_fragments() -> dict[str, str]:
    from gistmeter.functions import porter as k

    m1, m2 = f"regexp_matches({{s}}, '{k.MEASURE_1}')", f"regexp_matches({{s}}, '{k.MEASURE_2}')"
    cvc = f"(regexp_matches({{s}}, '{k.ENDS_CVC}') OR regexp_matches({{s}}, '{k.SHORT_VC}'))"
    vowel = f"regexp_matches({{s}}, '{k.HAS_VOWEL}')"

    def cut(n: int, w: str = "w") -> str:
        return f"left({w}, length({w}) - {n})"

    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in k.IRREGULAR.items())
    steps = {
        "st0": "SELECT tok, regexp_replace(regexp_replace(tok, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w "
               "FROM (SELECT DISTINCT raw AS tok FROM raw_rtok)",
        "st1": f"SELECT tok, CASE WHEN suffix(w, 'ies') AND length(w) = 4 THEN {cut(1)} ELSE " + _suffix_case(
            [("sses", "true", "ss"), ("ies", "true", "i"), ("ss", "true", "ss"), ("s", "true", "")]) + " END AS w FROM st0",
        "st2": f"""SELECT tok, w, CASE WHEN suffix(w, 'ied') OR suffix(w, 'eed') THEN NULL
            WHEN suffix(w, 'ed') AND {vowel.format(s=cut(2))} THEN {cut(2)}
            WHEN suffix(w, 'ing') AND {vowel.format(s=cut(3))} THEN {cut(3)} END AS b FROM st1""",
        "st3": f"""SELECT tok, CASE WHEN b IS NOT NULL THEN
              CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'
                   WHEN regexp_matches(b, '{k.DOUBLE}') THEN {cut(1, 'b')}
                   WHEN {m1.format(s='b')} AND NOT {m2.format(s='b')} AND {cvc.format(s='b')} THEN b || 'e' ELSE b END
            WHEN suffix(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN suffix(w, 'eed') AND {m1.format(s=cut(3))} THEN {cut(1)} ELSE w END AS w FROM st2""",
        "st4": f"SELECT tok, CASE WHEN regexp_matches(w, '^.+[^aeiouy]y$') THEN {cut(1)} || 'i' ELSE w END AS w FROM st3",
        "st5": f"SELECT tok, CASE WHEN suffix(w, 'alli') AND {m1.format(s=cut(4))} THEN {cut(2)} ELSE w END AS w FROM st4",
        "st6": f"SELECT tok, CASE WHEN suffix(w, 'logi') THEN CASE WHEN {m1.format(s=cut(3))} THEN {cut(1)} ELSE w END ELSE "
               + _suffix_case([(s, m1, e) for s, e in k.STEP_2 if s != "logi"]) + " END AS w FROM st5",
        "st7": "SELECT tok, " + _suffix_case([(s, m1, e) for s, e in k.STEP_3]) + " AS w FROM st6",
        "st8": "SELECT tok, " + _suffix_case([
            (s, m2 + (" AND regexp_matches({s}, '[st]$')" if s == "ion" else ""), "") for s in k.STEP_4]) + " AS w FROM st7",
        "st9": f"SELECT tok, CASE WHEN suffix(w, 'e') AND ({m2.format(s=cut(1))} OR ({m1.format(s=cut(1))} "
               f"AND NOT {cvc.format(s=cut(1))})) THEN {cut(1)} ELSE w END AS w FROM st8",
        "st10": f"SELECT tok, CASE WHEN suffix(w, 'll') AND {m2.format(s=cut(1))} THEN {cut(1)} ELSE w END AS w FROM st9",
        "stems": f"SELECT tok, CASE WHEN length(tok) < {k.MIN_LENGTH} THEN tok ELSE "
                 f"coalesce(CASE tok {irregular} END, lower(w)) END AS stem FROM st10",
    }
    return steps


FRAGMENTS.update(_stem_fragments())
