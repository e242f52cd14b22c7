"""Independent DuckDB SQL for every query (the correctness oracle).

Written by hand against the raw driver tables; the stand-in views are CTEs.
Integer sums stay integers; floats are rounded to 6 places.
"""

from __future__ import annotations

from moodweave import constants as K
from moodweave.functions.text import PUNCT, WS_RUN, WORD2

_WORDS = ", ".join(f"'{w}'" for w in K.FIXTURE_LEXICON_WORDS)
_STOP = ", ".join(f"('{w}')" for w in K.FIXTURE_STOPWORDS)
_ANCH = ", ".join(f"({i}, '{n}', {K.EMOTION_ANCHORS_MILLI[n][0]}, {K.EMOTION_ANCHORS_MILLI[n][1]}, "
                  f"{K.EMOTION_ANCHORS_MILLI[n][2]})" for i, n in K.TAG_EMOTIONS)

CTE = {
    "v_turns": """v_turns AS (
  SELECT conv_id,
         lpad(CAST(conv_id % 10 + 1 AS VARCHAR), 2, '0') || '_e' ||
         lpad(CAST(conv_id % 24 + 1 AS VARCHAR), 2, '0') || '_c' || CAST(conv_id AS VARCHAR) AS scene_id,
         turn AS pos,
         CASE WHEN role = 'user' AND turn % 4 < 2 THEN 'Una Smith'
              WHEN role = 'user' THEN 'Una Sr.'
              WHEN role = 'assistant' THEN 'Abe Jones'
              WHEN role = 'system' THEN 'Narrator' END AS speaker,
         text
  FROM conversations)""",
    "v_characters": """v_characters AS (
  SELECT DISTINCT conv_id, scene_id, speaker AS "character" FROM v_turns)""",
    "v_traits": """v_traits AS (
  SELECT c.conv_id, c.scene_id, c."character",
         l.quality = 1 AS cAGR,
         (SELECT count(*) FROM v_turns t WHERE t.conv_id = c.conv_id) >= 5 AS cCON,
         2 * (SELECT count(*) FROM v_turns t WHERE t.conv_id = c.conv_id AND t.speaker = c."character")
           >= (SELECT count(*) FROM v_turns t WHERE t.conv_id = c.conv_id) AS cEXT,
         c.conv_id % 2 = 0 AS cOPN,
         l.toxic = 1 AS cNEU
  FROM v_characters c LEFT JOIN labels l ON l.doc_id = c.conv_id)""",
    "anchors": f"""anchors AS (
  SELECT * FROM (VALUES {_ANCH}) AS x(emotion_id, emotion, av, aa, ad))""",
    "lexicon": f"""lexicon AS (
  SELECT w.word, an.av AS v, an.aa AS a, an.ad AS d
  FROM (SELECT unnest([{_WORDS}]) AS word, unnest(range(1, {len(K.FIXTURE_LEXICON_WORDS)} + 1)) AS k) w
  JOIN anchors an ON an.emotion_id = 1 + ((w.k - 1) % 6))""",
    "stopwords": f"""stopwords AS (SELECT * FROM (VALUES {_STOP}) AS s(word))""",
    "tagged": f"""turn_tokens AS (
  SELECT scene_id, pos, unnest(list_filter(regexp_split_to_array(
           regexp_replace(lower(text), '{PUNCT}', '', 'g'), '{WS_RUN}'), lambda x: x <> '')) AS word
  FROM v_turns),
turn_sums AS (
  SELECT t.scene_id, t.pos, t.speaker,
         count(l.word) AS n_matched,
         coalesce(sum(l.v), 0) AS sv, coalesce(sum(l.a), 0) AS sa, coalesce(sum(l.d), 0) AS sd
  FROM v_turns t
  LEFT JOIN (turn_tokens tt JOIN lexicon l ON l.word = tt.word)
         ON tt.scene_id = t.scene_id AND tt.pos = t.pos
  GROUP BY t.scene_id, t.pos, t.speaker),
tagged AS (
  SELECT scene_id, pos, speaker, n_matched, sv, emotion_id, emotion FROM (
    SELECT s.*, an.emotion_id, an.emotion,
           row_number() OVER (PARTITION BY s.scene_id, s.pos
             ORDER BY (s.n_matched * an.av - s.sv) * (s.n_matched * an.av - s.sv)
                    + (s.n_matched * an.aa - s.sa) * (s.n_matched * an.aa - s.sa)
                    + (s.n_matched * an.ad - s.sd) * (s.n_matched * an.ad - s.sd), an.emotion_id) AS rk
    FROM turn_sums s CROSS JOIN anchors an) WHERE rk = 1)""",
    "trait_long": """trait_long AS (
  SELECT scene_id, "character", 'A' AS trait, cAGR AS flag FROM v_traits UNION ALL
  SELECT scene_id, "character", 'C', cCON FROM v_traits UNION ALL
  SELECT scene_id, "character", 'E', cEXT FROM v_traits UNION ALL
  SELECT scene_id, "character", 'O', cOPN FROM v_traits UNION ALL
  SELECT scene_id, "character", 'N', cNEU FROM v_traits)""",
}

# Dependencies between CTEs, in definition order.
DEPS = {
    "v_turns": [], "v_characters": ["v_turns"], "v_traits": ["v_characters"],
    "anchors": [], "lexicon": ["anchors"], "stopwords": [],
    "tagged": ["v_turns", "lexicon"], "trait_long": ["v_traits"],
}


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["emotion_tag"] = with_ctes(["tagged"], """
SELECT scene_id, pos, CAST(n_matched AS BIGINT) AS n_matched, emotion FROM tagged""")

ORACLE["emotion_transition"] = with_ctes(["tagged", "trait_long"], """,
pairs AS (
  SELECT a.scene_id, a.emotion AS e_from, b.emotion AS e_to, b.speaker AS spk_to, a.speaker AS spk_from
  FROM tagged a JOIN tagged b ON b.scene_id = a.scene_id AND b.pos = a.pos + 1),
hits AS (
  SELECT s.trait, p.e_from, p.e_to, count(*) AS n
  FROM trait_long s JOIN pairs p ON p.scene_id = s.scene_id
  WHERE s.flag
    AND split_part(p.spk_from, ' ', 1) <> split_part(s."character", ' ', 1)
    AND split_part(p.spk_to, ' ', 1) = split_part(s."character", ' ', 1)
    AND p.e_from <> 'neutral' AND p.e_to <> 'neutral'
  GROUP BY ALL),
emos AS (SELECT * FROM (VALUES ('joy'), ('surprise'), ('anger'), ('sadness'), ('fear'), ('disgust')) e(e)),
grid AS (
  SELECT t.trait, f.e AS e_from, g.e AS e_to
  FROM (VALUES ('A'), ('C'), ('E'), ('O'), ('N')) t(trait), emos f, emos g)
SELECT g.trait, g.e_from, g.e_to, CAST(coalesce(h.n, 0) AS BIGINT) AS n,
       (round(coalesce(h.n, 0) / nullif(sum(coalesce(h.n, 0)) OVER (PARTITION BY g.trait, g.e_from), 0) * 1e6) / 1e6 + 0.0) AS ratio
FROM grid g LEFT JOIN hits h USING (trait, e_from, e_to)""")

ORACLE["emotion_distribution"] = with_ctes(["tagged", "trait_long"], """,
own AS (
  SELECT s.trait, s.flag, t.emotion, count(*) AS n
  FROM trait_long s
  JOIN tagged t ON t.scene_id = s.scene_id
   AND split_part(t.speaker, ' ', 1) = split_part(s."character", ' ', 1)
  WHERE s.flag IS NOT NULL
    AND t.pos < (SELECT max(pos) FROM tagged x WHERE x.scene_id = t.scene_id)
  GROUP BY ALL),
grid AS (
  SELECT t.trait, f.flag, e.emotion
  FROM (VALUES ('A', 'AGR'), ('C', 'CON'), ('E', 'EXT'), ('O', 'OPN'), ('N', 'NEU')) t(trait, nm),
       (VALUES (true), (false)) f(flag),
       (VALUES ('neutral'), ('joy'), ('surprise'), ('anger'), ('sadness'), ('fear'), ('disgust')) e(emotion))
SELECT g.trait, CAST(g.flag AS INTEGER) AS label,
       CASE WHEN g.flag THEN nm.nm ELSE 'non-' || nm.nm END AS personality,
       g.emotion, CAST(coalesce(o.n, 0) AS BIGINT) AS n,
       (round(coalesce(o.n, 0) / nullif(sum(coalesce(o.n, 0)) OVER (PARTITION BY g.trait, g.flag), 0) * 1e6) / 1e6 + 0.0) AS share
FROM grid g
JOIN (VALUES ('A', 'AGR'), ('C', 'CON'), ('E', 'EXT'), ('O', 'OPN'), ('N', 'NEU')) nm(trait, nm) USING (trait)
LEFT JOIN own o USING (trait, flag, emotion)""")

ORACLE["trait_labels"] = with_ctes(["trait_long"], """
SELECT scene_id, "character", trait, flag, CASE WHEN flag THEN 1 ELSE 0 END AS label FROM trait_long""")

ORACLE["trait_value_counts"] = with_ctes(["trait_long"], """
SELECT trait, flag, count(*) AS n FROM trait_long WHERE flag IS NOT NULL GROUP BY ALL""")

# --- dialogue structure ------------------------------------------------------
CTE["v_scenes"] = """v_scenes AS (
  SELECT conv_id, scene_id,
         'Scene note<br>' || string_agg('<b>' || speaker || '</b>: ' || text || '<br>', '' ORDER BY pos) AS raw_text
  FROM v_turns GROUP BY conv_id, scene_id)"""
CTE["sizes"] = """sizes AS (SELECT scene_id, count(*) AS n_turns FROM v_turns GROUP BY scene_id)"""
CTE["lens"] = """lens AS (SELECT CAST(x AS DOUBLE) AS flow_len FROM (VALUES (0.25), (0.5), (0.75), (1.0)) v(x))"""
CTE["turn_emo"] = """turn_emo AS (
  SELECT t.*, g.emotion FROM v_turns t JOIN tagged g ON g.scene_id = t.scene_id AND g.pos = t.pos)"""
_FIRST_T = "list_filter(regexp_split_to_array(@X@, '" + WS_RUN + "'), lambda w: w <> '')[1]"


class _First:
    @staticmethod
    def format(x):
        return _FIRST_T.replace("@X@", x)


_FIRST = _First()
CTE["sample_lens"] = """sample_lens AS (
  SELECT c.scene_id, c."character", l.flow_len, floor(s.n_turns * l.flow_len) AS k
  FROM v_characters c JOIN sizes s ON s.scene_id = c.scene_id CROSS JOIN lens l)"""
_DESC = ", ".join(f"('{t}', '{p}', '{x}')" for t, p, x in K.DESCRIPTIONS)
CTE["descriptions"] = f"""descriptions AS (SELECT * FROM (VALUES {_DESC}) d(trait, polarity, text))"""
CTE["seeds"] = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"({s})" for s in K.SEEDS) + ") s(seed))"
DEPS.update({"v_scenes": ["v_turns"], "sizes": ["v_turns"], "lens": [], "turn_emo": ["tagged"],
             "sample_lens": ["v_characters", "sizes", "lens"], "descriptions": [], "seeds": []})

ORACLE["parse_transcript"] = with_ctes(["v_scenes"], """,
pieces AS (
  SELECT scene_id, list_filter(string_split(raw_text, '<br>'), lambda p: contains(p, '</b>:')) AS l
  FROM v_scenes),
flat AS (SELECT scene_id, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM pieces)
SELECT scene_id, CAST(pos AS BIGINT) AS pos,
       replace(split_part(piece, '</b>:', 1), '<b>', '') AS speaker,
       split_part(piece, '</b>:', 2) AS text
FROM flat""")

ORACLE["flow_prefix"] = with_ctes(["sizes", "lens"], """
SELECT t.conv_id, t.scene_id, t.pos, t.speaker, t.text, l.flow_len
FROM v_turns t JOIN sizes s ON s.scene_id = t.scene_id CROSS JOIN lens l
WHERE t.pos < floor(s.n_turns * l.flow_len)""")

ORACLE["speaker_mask"] = with_ctes(["v_characters", "sizes"], """
SELECT c.scene_id, c."character", t.pos,
       CAST(split_part(t.speaker, ' ', 1) = split_part(c."character", ' ', 1) AS INTEGER) AS is_speaker,
       CAST(t.pos = 0 AS INTEGER) AS is_first,
       CAST(t.pos = s.n_turns - 1 AS INTEGER) AS is_last
FROM v_characters c JOIN v_turns t ON t.scene_id = c.scene_id JOIN sizes s ON s.scene_id = c.scene_id""")

ORACLE["speaker_text"] = with_ctes(["v_characters"], """
SELECT c.scene_id, c."character",
       coalesce((SELECT string_agg(' ' || t.text, '' ORDER BY t.pos) FROM v_turns t
                 WHERE t.scene_id = c.scene_id AND t.speaker = c."character"), '') AS utterance
FROM v_characters c""")

ORACLE["context_text"] = with_ctes(["v_characters"], """
SELECT c.scene_id, c."character",
       coalesce((SELECT string_agg(' ' || t.text, '' ORDER BY t.pos) FROM v_turns t
                 WHERE t.scene_id = c.scene_id AND t.speaker <> c."character"), '') AS context
FROM v_characters c""")

ORACLE["dialog_text"] = with_ctes(["v_characters"], """
SELECT c.scene_id, c."character",
       coalesce((SELECT string_agg(t.text, '' ORDER BY t.pos) FROM v_turns t
                 WHERE t.scene_id = c.scene_id), '') AS sent
FROM v_characters c""")

ORACLE["scene_key_parse"] = with_ctes(["v_characters"], f"""
SELECT scene_id, "character",
       CAST(split_part(scene_id, '_', 1) AS INTEGER) AS season,
       CAST(substr(split_part(scene_id, '_', 2), 2) AS INTEGER) AS episode,
       {_FIRST.format(x='"character"')} AS first_name
FROM v_characters""")

_ORIGIN = """coalesce((SELECT string_agg(CASE WHEN t.speaker = s."character" THEN 'Speaker' ELSE 'Others' END
                                || ' : ' || t.text || ', ', '' ORDER BY t.pos)
                 FROM v_turns t WHERE t.scene_id = s.scene_id AND t.pos < s.k), '') || '; '"""
_ONLY = """coalesce((SELECT string_agg(t.text || ', ', '' ORDER BY t.pos)
                 FROM v_turns t WHERE t.scene_id = s.scene_id AND t.pos < s.k
                   AND t.speaker = s."character"), '') || '; '"""
_PROMPT = ("""coalesce((SELECT string_agg(
                   CASE WHEN t.pos = 0 AND split_part(t.speaker, ' ', 1) <> split_part(s."character", ' ', 1)
                          THEN 'First, the emotion of others is ' || t.emotion || ', '
                        WHEN t.pos = 0
                          THEN 'The emotion of ' || {first} || ' is initially ' || t.emotion || ', '
                        WHEN split_part(t.speaker, ' ', 1) <> split_part(s."character", ' ', 1)
                          THEN 'the emotion of others is ' || t.emotion || ', '
                        ELSE {first} || ' respond with ' || t.emotion || ', ' END, '' ORDER BY t.pos)
                 FROM turn_emo t WHERE t.scene_id = s.scene_id AND t.pos < s.k), '')"""
           .replace("{first}", _FIRST.format(x='s."character"')))

ORACLE["premise_dialog"] = with_ctes(["sample_lens"], f"""
SELECT s.scene_id, s."character", s.flow_len, {_ORIGIN} AS origin_sent FROM sample_lens s""")

ORACLE["premise_speaker"] = with_ctes(["sample_lens"], f"""
SELECT s.scene_id, s."character", s.flow_len, {_ONLY} AS only_speaker FROM sample_lens s""")

ORACLE["affective_prompt"] = with_ctes(["sample_lens", "turn_emo"], f"""
SELECT s.scene_id, s."character", s.flow_len, {_PROMPT} AS affective_prompt FROM sample_lens s""")

ORACLE["nli_pairs"] = with_ctes(["sample_lens", "turn_emo", "trait_long", "descriptions"], f""",
texts AS (
  SELECT s.scene_id, s."character", s.flow_len, {_FIRST.format(x='s."character"')} AS c_name,
         {_ORIGIN} AS origin_sent, {_ONLY} AS only_speaker, {_PROMPT} AS affective_prompt
  FROM sample_lens s),
j AS (
  SELECT x.*, tl.trait, CASE WHEN tl.flag THEN 1 ELSE 0 END AS label,
         x.origin_sent || x.affective_prompt AS sp,
         x.c_name || ' ' || dp.text AS pos_d, x.c_name || ' ' || dn.text AS neg_d
  FROM texts x
  JOIN trait_long tl ON tl.scene_id = x.scene_id AND tl."character" = x."character"
  JOIN descriptions dp ON dp.trait = tl.trait AND dp.polarity = 'pos'
  JOIN descriptions dn ON dn.trait = tl.trait AND dn.polarity = 'neg')
SELECT scene_id, "character", trait, flow_len, label, label AS nli_label,
       origin_sent, origin_sent AS sent, only_speaker, affective_prompt, sp AS sent_and_prompt, sp AS affective_dialog,
       pos_d AS pos_personality_description, neg_d AS neg_personality_description,
       pos_d AS personality_description, sp AS sentence1, pos_d AS sentence2,
       sp || ' ; ' || pos_d || '; Is it correct? <mask>.' AS model_input
FROM j""")

ORACLE["nli_sweep_split"] = with_ctes(["trait_long", "lens", "seeds"], """,
hashed AS (
  SELECT tl.trait, l.flow_len, s.seed, CASE WHEN tl.flag THEN 1 ELSE 0 END AS label,
         ('0x' || substr(md5(CAST(s.seed AS VARCHAR) || ':' || tl.scene_id || ':' || tl."character"), 1, 8))::BIGINT AS h
  FROM trait_long tl CROSS JOIN lens l CROSS JOIN seeds s)
SELECT trait, flow_len, seed,
       CASE WHEN h % 100 < 80 THEN 'train' WHEN h % 100 < 90 THEN 'valid' ELSE 'test' END AS split,
       count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos
FROM hashed GROUP BY ALL""")

ORACLE["stratified_split"] = """
WITH e AS (SELECT d.doc_id, l.quality AS labels FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
h AS (SELECT doc_id, labels, ('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS h FROM e),
r AS (SELECT doc_id, labels,
             row_number() OVER (PARTITION BY labels ORDER BY h, doc_id) AS rk,
             count(*) OVER (PARTITION BY labels) AS n FROM h),
c AS (SELECT *, ceil(n * CAST(0.1 AS DOUBLE)) AS nt FROM r)
SELECT doc_id, labels,
       CASE WHEN rk <= nt THEN 'test'
            WHEN rk <= nt + ceil((n - nt) * CAST(0.1 AS DOUBLE)) THEN 'valid' ELSE 'train' END AS split
FROM c"""

ORACLE["emotion_regroup"] = with_ctes(["tagged"], """,
sz AS (SELECT t.conv_id, t.scene_id, count(*) AS len FROM v_turns t GROUP BY ALL),
st AS (SELECT scene_id, coalesce(sum(len) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM sz)
SELECT g.scene_id, CAST(g.pos AS BIGINT) AS pos, CAST(st.start + g.pos AS BIGINT) AS flat_idx, g.emotion
FROM tagged g JOIN st ON st.scene_id = g.scene_id""")

# --- lexicon and word statistics --------------------------------------------


def R6(x: str) -> str:
    """Round to 6 places; '+ 0.0' turns a negative zero into 0.0."""
    return f"(round(({x}) * 1e6) / 1e6 + 0.0)"


def _toks(text: str, repl: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '{PUNCT}', '{repl}', 'g'), "
            f"'{WS_RUN}'), lambda x: x <> '')")


CTE["doc_sums"] = f"""doc_tokens AS (
  SELECT doc_id, unnest({_toks('text', '')}) AS word FROM documents),
doc_sums AS (
  SELECT d.doc_id, count(t.word) AS n_tokens, count(l.word) AS n_matched,
         coalesce(sum(l.v), 0) AS sv, coalesce(sum(l.a), 0) AS sa, coalesce(sum(l.d), 0) AS sd
  FROM documents d LEFT JOIN doc_tokens t ON t.doc_id = d.doc_id LEFT JOIN lexicon l ON l.word = t.word
  GROUP BY d.doc_id)"""
CTE["doc_vad"] = """doc_vad AS (
  SELECT doc_id,
         CASE WHEN n_matched > 0 THEN sv / n_matched / 1000.0 ELSE 0.0 END AS v,
         CASE WHEN n_matched > 0 THEN sa / n_matched / 1000.0 ELSE 0.0 END AS a,
         CASE WHEN n_matched > 0 THEN sd / n_matched / 1000.0 ELSE 0.0 END AS d
  FROM doc_sums)"""
CTE["doc_b5"] = """doc_b5 AS (
  SELECT doc_id,
         0.83 * v + 0.19 * a + -0.21 * d AS A,
         0.23 * v + 0.12 * a + 0.82 * d AS E,
         v, d FROM doc_vad),
doc_big5 AS (
  SELECT doc_id, A, E,
         0.32 * v + 0.00 * A + 0.30 * d AS C,
         0.00 * v + -0.33 * A + 0.67 * d AS O,
         0.57 * v + -0.65 * A + 0.00 * d AS N
  FROM doc_b5)"""
CTE["v_essays"] = """v_essays AS (
  SELECT d.doc_id, d.text AS utterance, l.quality AS labels
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
CTE["essay_words"] = f"""essay_words AS (
  SELECT e.labels, w.word FROM (SELECT labels, unnest({_toks('utterance', ' ')}) AS word FROM v_essays) w
  JOIN (SELECT 1) ON true
  JOIN v_essays e ON false)"""
CTE["essay_words"] = f"""essay_words AS (
  SELECT labels, word FROM (SELECT labels, unnest({_toks('utterance', ' ')}) AS word FROM v_essays)
  WHERE word NOT IN (SELECT word FROM stopwords))"""
CTE["tfidf"] = f"""tf AS (
  SELECT labels, word, count(*) AS tf
  FROM (SELECT labels, unnest(regexp_extract_all(lower(utterance), '{WORD2}', 1)) AS word FROM v_essays)
  GROUP BY ALL),
tfw AS (
  SELECT tf.*, tf.tf * (ln(((SELECT count(DISTINCT labels) FROM v_essays) + 1)
                           / ((SELECT count(*) FROM tf t2 WHERE t2.word = tf.word) + 1)) + 1) AS w
  FROM tf),
tfidf AS (
  SELECT labels, word, tf, w, w / sqrt(sum(w * w) OVER (PARTITION BY labels)) AS tfidf,
         CAST(row_number() OVER (PARTITION BY labels ORDER BY w DESC, word) AS INTEGER) AS rank
  FROM tfw)"""
DEPS.update({"doc_sums": ["lexicon"], "doc_vad": ["doc_sums"], "doc_b5": ["doc_vad"], "v_essays": [],
             "essay_words": ["v_essays", "stopwords"], "tfidf": ["v_essays"]})

ORACLE["vad_matched"] = with_ctes(["doc_sums"], f"""
SELECT doc_id, n_tokens, n_matched,
       {R6("CASE WHEN n_matched > 0 THEN sv / n_matched / 1000.0 ELSE 0.0 END")} AS v,
       {R6("CASE WHEN n_matched > 0 THEN sa / n_matched / 1000.0 ELSE 0.0 END")} AS a,
       {R6("CASE WHEN n_matched > 0 THEN sd / n_matched / 1000.0 ELSE 0.0 END")} AS d
FROM doc_sums""")

ORACLE["vad_all_words"] = with_ctes(["doc_sums"], f"""
SELECT doc_id, n_tokens, n_matched,
       {R6("sv / nullif(n_tokens, 0) / 1000.0")} AS v,
       {R6("sa / nullif(n_tokens, 0) / 1000.0")} AS a,
       {R6("sd / nullif(n_tokens, 0) / 1000.0")} AS d
FROM doc_sums""").replace(_toks('text', ''), _toks('text', '').replace('lower(text)', 'text'))

ORACLE["big_five"] = with_ctes(["doc_b5"], f"""
SELECT doc_id, {R6("A")} AS A, {R6("C")} AS C, {R6("E")} AS E, {R6("O")} AS O, {R6("N")} AS N
FROM doc_big5""")

ORACLE["big_five_centered"] = with_ctes(["doc_b5"], f""",
feat AS (
  SELECT doc_id, 'A' AS trait, A * 10.0 AS score FROM doc_big5 UNION ALL
  SELECT doc_id, 'C', C * 10.0 FROM doc_big5 UNION ALL
  SELECT doc_id, 'E', E * 10.0 FROM doc_big5 UNION ALL
  SELECT doc_id, 'O', O * 10.0 FROM doc_big5 UNION ALL
  SELECT doc_id, 'N', N * 100.0 FROM doc_big5)
SELECT doc_id, trait, {R6("score")} AS score,
       {R6("score - avg(score) OVER (PARTITION BY trait)")} AS centered
FROM feat""")

ORACLE["class_vad"] = with_ctes(["essay_words", "lexicon"], f""",
j AS (SELECT w.labels, l.v, l.a, l.d FROM essay_words w LEFT JOIN lexicon l ON l.word = w.word)
SELECT labels, count(*) AS total, count(*) - count(v) AS oov,
       {R6("CAST(coalesce(sum(v), 0) AS DOUBLE) / nullif(count(v) * 1000.0, 0)")} AS v,
       {R6("CAST(coalesce(sum(a), 0) AS DOUBLE) / nullif(count(v) * 1000.0, 0)")} AS a,
       {R6("CAST(coalesce(sum(d), 0) AS DOUBLE) / nullif(count(v) * 1000.0, 0)")} AS d
FROM j GROUP BY labels""")

ORACLE["class_word_counts"] = with_ctes(["essay_words"], """
SELECT labels, word, count(*) AS n FROM essay_words GROUP BY ALL""")

ORACLE["class_top_words"] = with_ctes(["essay_words"], """,
c AS (SELECT labels, word, count(*) AS n FROM essay_words GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY labels ORDER BY n DESC, word) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 21""")

ORACLE["class_tfidf"] = with_ctes(["tfidf"], f"""
SELECT labels, word, tf, rank, {R6("tfidf")} AS tfidf FROM tfidf WHERE rank <= 200""")

ORACLE["class_tfidf_diff"] = with_ctes(["tfidf"], """,
top AS (SELECT labels, word FROM tfidf WHERE rank <= 200)
SELECT word, '1_only' AS direction FROM top WHERE labels = 1
  AND word NOT IN (SELECT word FROM top WHERE labels = 0)
UNION ALL
SELECT word, '0_only' FROM top WHERE labels = 0
  AND word NOT IN (SELECT word FROM top WHERE labels = 1)""")

_BIN = """count(*) AS n,
       count(*) FILTER (WHERE {L} = 1 AND {P} = 1) AS tp,
       count(*) FILTER (WHERE {L} <> 1 AND {P} = 1) AS fp,
       count(*) FILTER (WHERE {L} = 1 AND {P} <> 1) AS fn,
       count(*) FILTER (WHERE {L} <> 1 AND {P} <> 1) AS tn"""


def _bin(label: str, pred: str) -> str:
    return _BIN.replace("{L}", label).replace("{P}", pred)


_ACC = "coalesce(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 0.0)"
_F1 = "coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0)"
_MCC = ("coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt("
        "CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0)")

ORACLE["threshold_sweep"] = with_ctes(["v_essays", "lexicon"], f""",
toks AS (SELECT doc_id, unnest({_toks('utterance', '')}) AS word FROM v_essays),
s AS (
  SELECT e.doc_id, e.labels, count(l.word) AS n_matched,
         coalesce(sum(l.v), 0) AS sv, coalesce(sum(l.a), 0) AS sa, coalesce(sum(l.d), 0) AS sd
  FROM v_essays e LEFT JOIN toks t ON t.doc_id = e.doc_id LEFT JOIN lexicon l ON l.word = t.word
  GROUP BY e.doc_id, e.labels),
vad AS (
  SELECT labels,
         CASE WHEN n_matched > 0 THEN sv / n_matched / 1000.0 ELSE 0.0 END AS v,
         CASE WHEN n_matched > 0 THEN sa / n_matched / 1000.0 ELSE 0.0 END AS a,
         CASE WHEN n_matched > 0 THEN sd / n_matched / 1000.0 ELSE 0.0 END AS d FROM s),
sc AS (SELECT labels, 0.83 * v + 0.19 * a + -0.21 * d AS A FROM vad),
th AS (SELECT CAST(i AS DOUBLE) / 10.0 AS threshold FROM range(10) r(i)),
p AS (SELECT th.threshold, sc.labels, CAST(sc.A >= th.threshold AS INTEGER) AS pred FROM sc CROSS JOIN th),
g AS (SELECT threshold, {_bin('labels', 'pred')} FROM p GROUP BY threshold)
SELECT threshold, n, {R6(_ACC)} AS accuracy, {R6(_F1)} AS f1 FROM g""")

# --- scoring and evaluation --------------------------------------------------
CTE["v_logits"] = """v_logits AS (
  SELECT vec_id, """ + ", ".join(
    f"list_sum(list_transform(range({k}, len(embedding), 4), lambda i: CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1e6) AS BIGINT))) / 1e6 AS {c}"
    for k, c in enumerate(("pos0", "pos1", "neg0", "neg1"))) + """,
         label % 2 AS label
  FROM embeddings)"""
CTE["mc"] = """mc AS (
  SELECT vec_id, label,
         CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred
  FROM embeddings)"""
DEPS.update({"v_logits": [], "mc": []})

ORACLE["ensemble_pos_neg"] = with_ctes(["v_logits"], f"""
SELECT vec_id, label, {R6("pos0 + neg1")} AS p0, {R6("pos1 + neg0")} AS p1,
       CAST(pos1 + neg0 > pos0 + neg1 AS INTEGER) AS pred
FROM v_logits""")

ORACLE["late_fusion"] = with_ctes(["v_logits"], f""",
s AS (
  SELECT vec_id, label,
         exp(pos0 - greatest(pos0, pos1)) AS a0, exp(pos1 - greatest(pos0, pos1)) AS a1,
         exp(neg0 - greatest(neg0, neg1)) AS b0, exp(neg1 - greatest(neg0, neg1)) AS b1
  FROM v_logits),
f AS (SELECT vec_id, label, a0 / (a0 + a1) + b0 / (b0 + b1) AS f0, a1 / (a0 + a1) + b1 / (b0 + b1) AS f1 FROM s)
SELECT vec_id, label, {R6("f0")} AS fused0, {R6("f1")} AS fused1, CAST(f1 > f0 AS INTEGER) AS pred FROM f""")

ORACLE["speaker_pool"] = with_ctes(["tagged", "v_characters"], """,
own AS (
  SELECT c.scene_id, c."character", g.emotion
  FROM v_characters c JOIN tagged g ON g.scene_id = c.scene_id
   AND split_part(g.speaker, ' ', 1) = split_part(c."character", ' ', 1)),
agg AS (
  SELECT c.scene_id, c."character", count(o.emotion) AS n_own,
""" + ",\n".join(
    f"         count(*) FILTER (WHERE o.emotion = '{n}') AS c_{n}" for _, n in K.TAG_EMOTIONS) + """
  FROM v_characters c LEFT JOIN own o ON o.scene_id = c.scene_id AND o."character" = c."character"
  GROUP BY c.scene_id, c."character")
SELECT scene_id, "character", n_own, """ + ", ".join(
    R6(f"CAST(c_{n} AS DOUBLE) / nullif(n_own, 0)") + f" AS p_{n}" for _, n in K.TAG_EMOTIONS) + """
FROM agg""")

ORACLE["eval_metrics"] = with_ctes(["v_logits", "mc"], f""",
b AS (SELECT label, CAST(pos1 + neg0 > pos0 + neg1 AS INTEGER) AS pred FROM v_logits),
bg AS (SELECT {_bin('label', 'pred')} FROM b),
cls AS (SELECT label AS k FROM mc UNION SELECT pred FROM mc),
cc AS (
  SELECT k, (SELECT count(*) FROM mc WHERE label = k) AS t, (SELECT count(*) FROM mc WHERE pred = k) AS p
  FROM cls),
m AS (
  SELECT (SELECT count(*) FROM mc) AS n, (SELECT count(*) FROM mc WHERE label = pred) AS c,
         sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt FROM cc)
SELECT 'ensemble' AS task, n, {R6(_ACC)} AS accuracy, {R6(_F1)} AS f1, {R6(_MCC)} AS mcc FROM bg
UNION ALL
SELECT 'argmax', n, {R6("CAST(c AS DOUBLE) / n")}, NULL,
       {R6("coalesce((CAST(c AS DOUBLE) * n - pt) / nullif(sqrt((CAST(n AS DOUBLE) * n - pp) * (CAST(n AS DOUBLE) * n - tt)), 0), 0.0)")}
FROM m""")

ORACLE["classification_report"] = with_ctes(["mc"], f""",
cls AS (SELECT label AS k FROM mc UNION SELECT pred FROM mc),
cc AS (
  SELECT k, (SELECT count(*) FROM mc WHERE label = k) AS t, (SELECT count(*) FROM mc WHERE pred = k) AS p,
         (SELECT count(*) FROM mc WHERE label = k AND pred = k) AS h FROM cls),
per AS (
  SELECT CAST(k AS VARCHAR) AS cls,
         coalesce(CAST(h AS DOUBLE) / nullif(p, 0), 0.0) AS precision,
         coalesce(CAST(h AS DOUBLE) / nullif(t, 0), 0.0) AS recall,
         coalesce(CAST(2 * h AS DOUBLE) / nullif(p + t, 0), 0.0) AS f1, t AS support FROM cc),
tot AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(support * precision) AS wp, sum(support * recall) AS wr,
               sum(support * f1) AS wf, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               (SELECT count(*) FROM mc WHERE label = pred) AS hits FROM per)
SELECT cls, {R6("precision")} AS precision, {R6("recall")} AS recall, {R6("f1")} AS f1, support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, {R6("CAST(hits AS DOUBLE) / n")}, n FROM tot
UNION ALL SELECT 'macro avg', {R6("mp")}, {R6("mr")}, {R6("mf")}, n FROM tot
UNION ALL SELECT 'weighted avg', {R6("wp / n")}, {R6("wr / n")}, {R6("wf / n")}, n FROM tot""")

ORACLE["classification_report_swapped"] = with_ctes(["mc"], f""",
mx AS (SELECT vec_id, pred AS label, label AS pred FROM mc),
cls AS (SELECT label AS k FROM mx UNION SELECT pred FROM mx),
cc AS (
  SELECT k, (SELECT count(*) FROM mx WHERE label = k) AS t, (SELECT count(*) FROM mx WHERE pred = k) AS p,
         (SELECT count(*) FROM mx WHERE label = k AND pred = k) AS h FROM cls),
per AS (
  SELECT CAST(k AS VARCHAR) AS cls,
         coalesce(CAST(h AS DOUBLE) / nullif(p, 0), 0.0) AS precision,
         coalesce(CAST(h AS DOUBLE) / nullif(t, 0), 0.0) AS recall,
         coalesce(CAST(2 * h AS DOUBLE) / nullif(p + t, 0), 0.0) AS f1, t AS support FROM cc),
tot AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(support * precision) AS wp, sum(support * recall) AS wr,
               sum(support * f1) AS wf, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               (SELECT count(*) FROM mx WHERE label = pred) AS hits FROM per)
SELECT cls, {R6("precision")} AS precision, {R6("recall")} AS recall, {R6("f1")} AS f1, support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, {R6("CAST(hits AS DOUBLE) / n")}, n FROM tot
UNION ALL SELECT 'macro avg', {R6("mp")}, {R6("mr")}, {R6("mf")}, n FROM tot
UNION ALL SELECT 'weighted avg', {R6("wp / n")}, {R6("wr / n")}, {R6("wf / n")}, n FROM tot""")

ORACLE["confusion"] = with_ctes(["mc"], """
SELECT label, pred, count(*) AS n FROM mc GROUP BY ALL""")

# Multinomial naive Bayes per input mode, trait and seed; validation F1 picks the smoothing.
_SEEDS3 = "(VALUES (0), (42), (3407)) s(seed)"


def _word2(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD2}', 1)"


_ALPHAS = (0.1, 1.0, 10.0)
CTE["classified"] = f"""sweep AS (
  SELECT scene_id, "character", trait, seed, label,
         CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT tl.scene_id, tl."character", tl.trait, s.seed, CASE WHEN tl.flag THEN 1 ELSE 0 END AS label,
               ('0x' || substr(md5(CAST(s.seed AS VARCHAR) || ':' || tl.scene_id || ':' || tl."character"), 1, 8))::BIGINT % 100 AS b
        FROM trait_long tl, {_SEEDS3})),
bags AS (
  SELECT 'speaker' AS mode, scene_id, "character", word, count(*) AS tf FROM (
    SELECT c.scene_id, c."character", unnest({_word2('t.text')}) AS word
    FROM v_characters c JOIN v_turns t ON t.scene_id = c.scene_id AND t.speaker = c."character") GROUP BY ALL
  UNION ALL
  SELECT 'speaker_context', scene_id, "character", word, count(*) FROM (
    SELECT c.scene_id, c."character", CASE WHEN t.speaker = c."character" THEN 'own:' ELSE 'other:' END || unnest({_word2('t.text')}) AS word
    FROM v_characters c JOIN v_turns t ON t.scene_id = c.scene_id) GROUP BY ALL
  UNION ALL
  SELECT 'dialog', scene_id, "character", word, count(*) FROM (
    SELECT c.scene_id, c."character", unnest({_word2('t.text')}) AS word
    FROM v_characters c JOIN v_turns t ON t.scene_id = c.scene_id) GROUP BY ALL
  UNION ALL
  SELECT 'features', c.scene_id, c."character", g.emotion, count(*)
  FROM v_characters c JOIN tagged g ON g.scene_id = c.scene_id
   AND split_part(g.speaker, ' ', 1) = split_part(c."character", ' ', 1) GROUP BY ALL),
docs AS (SELECT trait, seed, CAST(sum(label) AS BIGINT) AS d1, count(*) AS d FROM sweep WHERE split = 'train' GROUP BY ALL),
wc AS (
  SELECT b.mode, s.trait, s.seed, b.word, sum(CASE WHEN s.label = 1 THEN b.tf ELSE 0 END) AS n1, sum(b.tf) AS n
  FROM bags b JOIN sweep s ON s.scene_id = b.scene_id AND s."character" = b."character" WHERE s.split = 'train' GROUP BY ALL),
tot AS (SELECT mode, trait, seed, sum(n1) AS t1, sum(n) AS t, count(*) AS v FROM wc GROUP BY ALL),
alphas AS (SELECT * FROM (VALUES {', '.join(f'({k}, CAST({a} AS DOUBLE))' for k, a in enumerate(_ALPHAS))}) a(k, alpha)),
gain AS (
  SELECT b.mode, s.trait, s.seed, s.scene_id, s."character", a.k, sum(b.tf) AS size,
         sum(b.tf * ln((w.n1 + a.alpha) / (w.n - w.n1 + a.alpha))) AS g
  FROM bags b JOIN sweep s ON s.scene_id = b.scene_id AND s."character" = b."character"
  JOIN wc w ON w.mode = b.mode AND w.trait = s.trait AND w.seed = s.seed AND w.word = b.word
  CROSS JOIN alphas a WHERE s.split <> 'train' GROUP BY ALL),
pr AS (
  SELECT m.mode, s.trait, s.seed, s.scene_id, s."character", s.label, s.split, a.k, a.alpha,
         CASE WHEN coalesce(d.d1, 0) = 0 THEN 0 WHEN d.d - d.d1 = 0 THEN 1
              WHEN round(ln(CAST(d.d1 AS DOUBLE) / (d.d - d.d1)) + coalesce(g.g, 0)
                   - coalesce(g.size, 0) * coalesce(ln((t.t1 + t.v * a.alpha) / (t.t - t.t1 + t.v * a.alpha)), 0), 9) > 0
              THEN 1 ELSE 0 END AS pred
  FROM sweep s CROSS JOIN (SELECT DISTINCT mode FROM bags) m CROSS JOIN alphas a
  LEFT JOIN docs d ON d.trait = s.trait AND d.seed = s.seed
  LEFT JOIN tot t ON t.mode = m.mode AND t.trait = s.trait AND t.seed = s.seed
  LEFT JOIN gain g ON g.mode = m.mode AND g.trait = s.trait AND g.seed = s.seed
   AND g.scene_id = s.scene_id AND g."character" = s."character" AND g.k = a.k
  WHERE s.split <> 'train'),
val AS (
  SELECT mode, trait, seed, k, {_bin('label', 'pred')} FROM pr WHERE split = 'valid' GROUP BY mode, trait, seed, k),
pick AS (SELECT mode, trait, seed, k FROM (
  SELECT *, row_number() OVER (PARTITION BY mode, trait, seed ORDER BY round({_F1}, 9) DESC, k) AS rk FROM val) WHERE rk = 1),
classified AS (
  SELECT p.mode, p.trait, p.seed, p.scene_id, p."character", p.label, p.alpha, p.pred
  FROM pr p LEFT JOIN pick x ON x.mode = p.mode AND x.trait = p.trait AND x.seed = p.seed
  WHERE p.split = 'test' AND p.k = coalesce(x.k, 0))"""
DEPS["classified"] = ["trait_long", "tagged"]
ORACLE["trait_classifier"] = with_ctes(["classified"], "\nSELECT * FROM classified")
ORACLE["result_grid"] = with_ctes(["classified"], f""",
g AS (SELECT mode, trait, seed, {_bin('label', 'pred')} FROM classified GROUP BY mode, trait, seed),
cell AS (SELECT mode, trait, seed, n, {_ACC} AS accuracy, {_F1} AS f1 FROM g)
SELECT mode, trait, seed, n, {R6("accuracy")} AS accuracy, {R6("f1")} AS f1,
       {R6("avg(accuracy) OVER (PARTITION BY mode, trait)")} AS acc_mean,
       {R6("avg(f1) OVER (PARTITION BY mode, trait)")} AS f1_mean,
       {R6("stddev_samp(accuracy) OVER (PARTITION BY mode, trait)")} AS acc_std
FROM cell""")

# Exact sweep splits: rows ranked by (hash, keys); the first ceil of half of ceil(0.2 n) are test, the others of it valid.
_HASH = "('0x' || substr(md5(CAST(s.seed AS VARCHAR) || ':' || tl.scene_id || ':' || tl.\"character\"), 1, 8))::BIGINT"
_EXACT = """CASE WHEN rk <= ceil(ceil(n * CAST(0.2 AS DOUBLE)) / 2.0) THEN 'test'
            WHEN rk <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'valid' ELSE 'train' END"""
ORACLE["exact_sweep_split"] = with_ctes(["trait_long", "lens", "seeds"], f""",
hashed AS (
  SELECT tl.trait, l.flow_len, s.seed, CASE WHEN tl.flag THEN 1 ELSE 0 END AS label, {_HASH} AS h, tl.scene_id, tl."character"
  FROM trait_long tl CROSS JOIN lens l CROSS JOIN seeds s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trait, flow_len, seed ORDER BY h, scene_id, "character") AS rk,
                  count(*) OVER (PARTITION BY trait, flow_len, seed) AS n FROM hashed)
SELECT trait, flow_len, seed, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(h) AS BIGINT) AS members
FROM (SELECT trait, flow_len, seed, label, h, {_EXACT} AS split FROM ranked) GROUP BY ALL""")

# Logistic regression by full-batch gradient steps from zero weights, a CTE a step.
_T, _RATE = 6, "4.0::DOUBLE"
_ON = 'ON f.flow_len = {0}.flow_len AND f.mode = {0}.mode AND '
_SAME = 'f.scene_id = {0}.scene_id AND f."character" = {0}."character"'


def _step(k: int) -> str:
    z, t = _SAME.format("z"), _SAME.format("t")
    grad = (f"""
g{k} AS (
  SELECT f.flow_len, f.mode, f.word, t.trait, t.seed, sum(f.x * ((1 / (1 + exp(-z.z)) - t.label) * t.share)) AS g
  FROM fx f JOIN z{k - 1} z {_ON.format('z')} {z} JOIN tr t ON {t} AND t.trait = z.trait AND t.seed = z.seed
  WHERE t.split = 'train' GROUP BY ALL),
w{k} AS MATERIALIZED (
  SELECT w.flow_len, w.mode, w.word, w.trait, w.seed, w.w - {_RATE} * coalesce(g.g, 0) AS w
  FROM w{k - 1} w LEFT JOIN g{k} g ON g.flow_len = w.flow_len AND g.mode = w.mode AND g.word = w.word
   AND g.trait = w.trait AND g.seed = w.seed),""" if k > 1 else f"""
w1 AS MATERIALIZED (
  SELECT f.flow_len, f.mode, f.word, t.trait, t.seed,
         -{_RATE} * sum(f.x * ((0.5::DOUBLE - t.label) * CASE WHEN t.split = 'train' THEN t.share ELSE 0 END)) AS w
  FROM fx f JOIN tr t ON {t} GROUP BY ALL),""")
    return grad + f"""
z{k} AS MATERIALIZED (
  SELECT f.flow_len, f.mode, f.scene_id, f."character", w.trait, w.seed, sum(f.x * w.w) AS z
  FROM fx f JOIN w{k} w {_ON.format('w')} f.word = w.word GROUP BY ALL),"""


def _words_at(mode: str, word: str, own: str) -> str:
    return f"""
  SELECT '{mode}' AS mode, l.flow_len, c.scene_id, c."character", {word} AS word
  FROM v_characters c JOIN v_turns t ON t.scene_id = c.scene_id{own} JOIN sizes z ON z.scene_id = t.scene_id CROSS JOIN lens l
  WHERE t.pos < floor(z.n_turns * l.flow_len)"""


ORACLE["trained_grid"] = with_ctes(["trait_long", "tagged", "sizes", "lens"], f""",
rk AS (
  SELECT *, row_number() OVER (PARTITION BY trait, seed ORDER BY h, scene_id, "character") AS rk,
         count(*) OVER (PARTITION BY trait, seed) AS n
  FROM (SELECT tl.scene_id, tl."character", tl.trait, s.seed, CASE WHEN tl.flag THEN 1 ELSE 0 END AS label, {_HASH} AS h
        FROM trait_long tl, {_SEEDS3})),
sp AS (SELECT scene_id, "character", trait, seed, label, {_EXACT} AS split FROM rk),
tr AS MATERIALIZED (
  SELECT *, 1.0::DOUBLE / nullif(count(*) FILTER (split = 'train') OVER (PARTITION BY trait, seed), 0) AS share FROM sp),
fb AS MATERIALIZED (SELECT flow_len, mode, scene_id, "character", word, count(*) AS tf FROM (
  {_words_at('speaker', f"unnest({_word2('t.text')})", ' AND t.speaker = c."character"')}
  UNION ALL {_words_at('speaker_context', "CASE WHEN t.speaker = c." + '"character"' + f" THEN 'own:' ELSE 'other:' END || unnest({_word2('t.text')})", '')}
  UNION ALL {_words_at('dialog', f"unnest({_word2('t.text')})", '')}
  UNION ALL {_words_at('features', 't.emotion', " AND split_part(t.speaker, ' ', 1) = split_part(c." + '"character"' + ", ' ', 1)").replace('v_turns t', 'tagged t')}
  ) GROUP BY ALL),
ns AS (SELECT flow_len, mode, count(*) AS n FROM (SELECT DISTINCT flow_len, mode, scene_id, "character" FROM fb) GROUP BY ALL),
dfs AS (SELECT flow_len, mode, word, count(*) AS df FROM fb GROUP BY ALL),
raw AS (
  SELECT f.*, f.tf * (ln((1 + n.n)::DOUBLE / (1 + d.df)) + 1) AS v
  FROM fb f JOIN dfs d {_ON.format('d')} f.word = d.word JOIN ns n {_ON.format('n')} true),
fx AS MATERIALIZED (
  SELECT flow_len, mode, scene_id, "character", word,
         v / sqrt(sum(v * v) OVER (PARTITION BY flow_len, mode, scene_id, "character")) AS x FROM raw
  UNION ALL SELECT l.flow_len, m.mode, c.scene_id, c."character", '', 1.0
  FROM v_characters c CROSS JOIN lens l CROSS JOIN (VALUES ('speaker'), ('speaker_context'), ('dialog'), ('features')) m(mode)),
{''.join(_step(k) for k in range(1, _T + 1))}
sc AS ({' UNION ALL '.join(f'SELECT {k} AS step, * FROM z{k}' for k in range(1, _T + 1))}),
pr AS (
  SELECT f.*, t.label, t.split, CASE WHEN round(f.z, 9) > 0 THEN 1 ELSE 0 END AS pred
  FROM sc f JOIN tr t ON {_SAME.format('t')} AND t.trait = f.trait AND t.seed = f.seed),
val AS (SELECT flow_len, mode, trait, seed, step, {_bin('label', 'pred')} FROM pr WHERE split = 'valid' GROUP BY flow_len, mode, trait, seed, step),
pick AS (SELECT * FROM val QUALIFY row_number() OVER (PARTITION BY flow_len, mode, trait, seed ORDER BY round({_F1}, 9) DESC, step) = 1),
best AS (
  SELECT p.*, coalesce(k.step, 1) AS best_step FROM pr p LEFT JOIN pick k
   ON k.flow_len = p.flow_len AND k.mode = p.mode AND k.trait = p.trait AND k.seed = p.seed WHERE p.split = 'test'),
g AS (SELECT flow_len, mode, trait, seed, best_step, {_bin('label', 'pred')} FROM best WHERE step = best_step
      GROUP BY flow_len, mode, trait, seed, best_step),
cell AS (SELECT flow_len, mode, trait, seed, best_step, n, {_ACC} AS accuracy, {_F1} AS f1 FROM g)
SELECT flow_len, mode, trait, seed, best_step, n, {R6("accuracy")} AS accuracy, {R6("f1")} AS f1,
       {R6("avg(accuracy) OVER (PARTITION BY flow_len, mode, trait)")} AS acc_mean,
       {R6("avg(f1) OVER (PARTITION BY flow_len, mode, trait)")} AS f1_mean,
       {R6("stddev_samp(accuracy) OVER (PARTITION BY flow_len, mode, trait)")} AS acc_std
FROM cell""")

# --- corpus alignment --------------------------------------------------------
_NAMES = ", ".join(f"'{n}'" for n, _ in K.ANNOTATION_CODES)
CTE["v_annotations"] = f"""ann_base AS (
  SELECT CAST(split_part(scene_id, '_', 1) AS INTEGER) AS Season,
         CAST(substr(split_part(scene_id, '_', 2), 2) AS INTEGER) AS Episode,
         '[''' || speaker || CASE WHEN pos % 2 = 0 THEN ''', ''Abe Jones'']' ELSE ''']' END AS Speaker,
         CASE WHEN pos % 3 = 0 THEN lower(text) WHEN pos % 3 = 1 THEN text || ' extra' ELSE 'so, ' || text END AS Utterance,
         [{_NAMES}][length(text) % 7 + 1] AS Emotion,
         CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split,
         conv_id * 100 + pos AS ann_order, conv_id
  FROM v_turns),
v_annotations AS (
  SELECT * EXCLUDE (conv_id) FROM ann_base
  UNION ALL SELECT * EXCLUDE (conv_id) FROM ann_base WHERE conv_id % 7 = 0),
ann AS (
  SELECT Season, Episode, Speaker, Utterance, Emotion, min(ann_order) AS ann_order
  FROM v_annotations GROUP BY ALL),
turn_keys AS (
  SELECT scene_id, pos, CAST(split_part(scene_id, '_', 1) AS INTEGER) AS season,
         CAST(substr(split_part(scene_id, '_', 2), 2) AS INTEGER) AS episode,
         {_FIRST.format(x='speaker')} AS spk, lower(text) AS t
  FROM v_turns)"""
DEPS["v_annotations"] = ["v_turns"]


def _align_sql(variant: str) -> str:
    listed = "regexp_extract(Speaker, '^.''([^'']*)''', 1)"
    spk = _FIRST.format(x=listed) if variant == "emory" else "Speaker"
    u = "lower(Utterance)" if variant == "emory" else "Utterance"
    return f"""{variant}_m AS (
  SELECT k.scene_id, k.pos, arg_min(a.Emotion, a.ann_order) AS emotion
  FROM turn_keys k JOIN (SELECT Season, Episode, {spk} AS spk, {u} AS u, Emotion, ann_order FROM ann) a
    ON a.Season = k.season AND a.Episode = k.episode AND a.spk = k.spk
   AND (k.t = a.u OR contains(a.u, k.t) OR contains(k.t, a.u))
  GROUP BY k.scene_id, k.pos),
{variant} AS (
  SELECT k.scene_id, k.pos, m.emotion FROM turn_keys k
  LEFT JOIN {variant}_m m ON m.scene_id = k.scene_id AND m.pos = k.pos)"""


ORACLE["align_emory"] = with_ctes(["v_annotations"], ",\n" + _align_sql("emory") + """
SELECT * FROM emory""")
ORACLE["align_emory_grams"] = ORACLE["align_emory"]
ORACLE["align_meld"] = with_ctes(["v_annotations"], ",\n" + _align_sql("meld") + """
SELECT * FROM meld""")
ORACLE["align_coverage"] = with_ctes(["v_annotations"], ",\n" + _align_sql("emory") + ",\n"
                                     + _align_sql("meld") + f"""
SELECT (SELECT count(*) FROM emory) AS n_turns,
       (SELECT count(emotion) FROM emory) AS emory_labelled,
       (SELECT count(emotion) FROM meld) AS meld_labelled,
       {R6("(SELECT count(emotion) FROM emory) / (SELECT count(*) FROM emory)")} AS emory_coverage,
       {R6("(SELECT count(emotion) FROM meld) / (SELECT count(*) FROM meld)")} AS meld_coverage""")
ORACLE["labelled_dialogs"] = with_ctes(["v_annotations"], ",\n" + _align_sql("emory") + ",\n"
                                       + _align_sql("meld") + """
SELECT e.scene_id, e.any_emory, e.all_emory, m.any_meld, m.all_meld
FROM (SELECT scene_id, bool_or(emotion IS NOT NULL) AS any_emory, bool_and(emotion IS NOT NULL) AS all_emory
      FROM emory GROUP BY scene_id) e
JOIN (SELECT scene_id, bool_or(emotion IS NOT NULL) AS any_meld, bool_and(emotion IS NOT NULL) AS all_meld
      FROM meld GROUP BY scene_id) m ON m.scene_id = e.scene_id""")

# --- encodings ---------------------------------------------------------------
_SENT = "CASE WHEN g.sv > 0 THEN 'positive' WHEN g.sv < 0 THEN 'negative' ELSE 'neutral' END"
CTE["v_triples"] = "v_triples AS (\n  SELECT t.conv_id, t.pos // 3 AS part,\n" + ",\n".join(
    f"         max(CASE WHEN t.pos % 3 = {i} THEN t.text END) AS Utterance_{i + 1},\n"
    f"         max(CASE WHEN t.pos % 3 = {i} THEN g.emotion END) AS Emotion_{i + 1},\n"
    f"         max(CASE WHEN t.pos % 3 = {i} THEN {_SENT} END) AS Sentiment_{i + 1}" for i in range(3)) + """
  FROM v_turns t JOIN tagged g ON g.scene_id = t.scene_id AND g.pos = t.pos
  GROUP BY t.conv_id, t.pos // 3),
unpiv AS (""" + "\n  UNION ALL ".join(
    f"SELECT conv_id, part, {i} AS slot, Utterance_{i} AS Utterance, Emotion_{i} AS Emotion, "
    f"Sentiment_{i} AS Sentiment FROM v_triples" for i in (1, 2, 3)) + ")"
CTE["vocab"] = f"""tok AS (SELECT scene_id, pos, speaker, {_toks('text', '')} AS toks FROM v_turns),
vocab AS (
  SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS id
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM tok) GROUP BY word))"""
DEPS.update({"v_triples": ["tagged"], "vocab": ["v_turns"]})


def _lst(x: str) -> str:
    return f"'[' || array_to_string({x}, ', ') || ']'"


ORACLE["utterance_unpivot"] = with_ctes(["v_triples"], "\nSELECT * FROM unpiv")

ORACLE["label_encode"] = with_ctes(["v_triples"], """,
ids AS (SELECT Emotion, CAST(row_number() OVER (ORDER BY Emotion) - 1 AS INTEGER) AS label_id
        FROM (SELECT DISTINCT Emotion FROM unpiv WHERE Emotion IS NOT NULL))
SELECT u.conv_id, u.part, u.slot, u.Emotion, i.label_id FROM unpiv u LEFT JOIN ids i ON i.Emotion = u.Emotion""")

ORACLE["mask_pad"] = with_ctes(["v_characters"], f"""
SELECT c.scene_id, c."character", count(t.pos) AS n_turns,
       {_lst('''list_resize(coalesce(list(CAST(split_part(t.speaker, ' ', 1) = split_part(c."character", ' ', 1) AS INTEGER)
                 ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []), 20, -1)''')} AS dialog_state
FROM v_characters c LEFT JOIN v_turns t ON t.scene_id = c.scene_id AND t.pos < 20
GROUP BY c.scene_id, c."character\"""")

ORACLE["mask_full"] = with_ctes(["v_characters"], f"""
SELECT c.scene_id, c."character", count(t.pos) AS n_turns,
       {_lst('''(coalesce(list(CAST(split_part(t.speaker, ' ', 1) = split_part(c."character", ' ', 1) AS INTEGER)
                 ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []))''')} AS dialog_state
FROM v_characters c LEFT JOIN v_turns t ON t.scene_id = c.scene_id
GROUP BY c.scene_id, c."character\"""")

ORACLE["encode_ids"] = with_ctes(["vocab"], f""",
tp AS (SELECT scene_id, pos, unnest(toks) AS word, unnest(range(len(toks))) AS gpos FROM tok),
ids AS (SELECT tp.scene_id, tp.pos, list(v.id ORDER BY tp.gpos) AS ids
        FROM tp JOIN vocab v ON v.word = tp.word WHERE tp.gpos < 126 GROUP BY tp.scene_id, tp.pos),
full_ids AS (
  SELECT t.scene_id, t.pos, CAST(len(t.toks) AS INTEGER) AS n_tokens,
         list_resize(list_concat([1], coalesce(i.ids, []), [2]), 128, 0) AS f
  FROM tok t LEFT JOIN ids i ON i.scene_id = t.scene_id AND i.pos = t.pos)
SELECT scene_id, pos, n_tokens, {_lst('f')} AS input_ids,
       {_lst("list_transform(f, lambda x: CAST(CAST(x > 0 AS INTEGER) AS DOUBLE))")} AS attention_mask
FROM full_ids""")

ORACLE["encode_ids_full"] = with_ctes(["vocab"], f""",
tp AS (SELECT scene_id, pos, unnest(toks) AS word, unnest(range(len(toks))) AS gpos FROM tok),
ids AS (SELECT tp.scene_id, tp.pos, list(v.id ORDER BY tp.gpos) AS ids
        FROM tp JOIN vocab v ON v.word = tp.word GROUP BY tp.scene_id, tp.pos),
full_ids AS (
  SELECT t.scene_id, t.pos, CAST(len(t.toks) AS INTEGER) AS n_tokens,
         list_concat([1], coalesce(i.ids, []), [2]) AS f
  FROM tok t LEFT JOIN ids i ON i.scene_id = t.scene_id AND i.pos = t.pos)
SELECT scene_id, pos, n_tokens, {_lst('f')} AS input_ids,
       {_lst("list_transform(f, lambda x: CAST(CAST(x > 0 AS INTEGER) AS DOUBLE))")} AS attention_mask
FROM full_ids""")

ORACLE["segment_ids"] = with_ctes(["vocab", "v_characters"], f""",
sides AS (
  SELECT c.scene_id, c."character",
         coalesce(flatten(list(t.toks ORDER BY t.pos) FILTER (WHERE t.speaker = c."character")), [])[1:62] AS u,
         coalesce(flatten(list(t.toks ORDER BY t.pos) FILTER (WHERE t.speaker IS DISTINCT FROM c."character")), [])[1:62] AS x
  FROM v_characters c LEFT JOIN tok t ON t.scene_id = c.scene_id
  GROUP BY c.scene_id, c."character"),
uu AS (SELECT scene_id, "character", unnest(u) AS word, unnest(range(len(u))) AS i FROM sides),
xx AS (SELECT scene_id, "character", unnest(x) AS word, unnest(range(len(x))) AS i FROM sides),
uid AS (SELECT scene_id, "character", list(v.id ORDER BY i) AS ids FROM uu JOIN vocab v USING (word) GROUP BY ALL),
xid AS (SELECT scene_id, "character", list(v.id ORDER BY i) AS ids FROM xx JOIN vocab v USING (word) GROUP BY ALL),
j AS (SELECT s.scene_id, s."character", coalesce(uid.ids, []) AS a, coalesce(xid.ids, []) AS b
      FROM sides s LEFT JOIN uid ON uid.scene_id = s.scene_id AND uid."character" = s."character"
      LEFT JOIN xid ON xid.scene_id = s.scene_id AND xid."character" = s."character")
SELECT scene_id, "character",
       {_lst("list_concat([1], a, [2], b, [2])")} AS input_ids,
       {_lst("list_concat(list_transform(range(len(a) + 2), lambda q: 1), list_transform(range(len(b) + 1), lambda q: 0))")} AS segment_ids
FROM j""")

ORACLE["segment_ids_full"] = with_ctes(["vocab", "v_characters"], f""",
sides AS (
  SELECT c.scene_id, c."character",
         coalesce(flatten(list(t.toks ORDER BY t.pos) FILTER (WHERE t.speaker = c."character")), []) AS u,
         coalesce(flatten(list(t.toks ORDER BY t.pos) FILTER (WHERE t.speaker IS DISTINCT FROM c."character")), []) AS x
  FROM v_characters c LEFT JOIN tok t ON t.scene_id = c.scene_id
  GROUP BY c.scene_id, c."character"),
uu AS (SELECT scene_id, "character", unnest(u) AS word, unnest(range(len(u))) AS i FROM sides),
xx AS (SELECT scene_id, "character", unnest(x) AS word, unnest(range(len(x))) AS i FROM sides),
uid AS (SELECT scene_id, "character", list(v.id ORDER BY i) AS ids FROM uu JOIN vocab v USING (word) GROUP BY ALL),
xid AS (SELECT scene_id, "character", list(v.id ORDER BY i) AS ids FROM xx JOIN vocab v USING (word) GROUP BY ALL),
j AS (SELECT s.scene_id, s."character", coalesce(uid.ids, []) AS a, coalesce(xid.ids, []) AS b
      FROM sides s LEFT JOIN uid ON uid.scene_id = s.scene_id AND uid."character" = s."character"
      LEFT JOIN xid ON xid.scene_id = s.scene_id AND xid."character" = s."character")
SELECT scene_id, "character",
       {_lst("list_concat([1], a, [2], b, [2])")} AS input_ids,
       {_lst("list_concat(list_transform(range(len(a) + 2), lambda q: 1), list_transform(range(len(b) + 1), lambda q: 0))")} AS segment_ids
FROM j""")

# --- sources and sinks -------------------------------------------------------
ORACLE["roundtrip_tsv"] = """
SELECT d.doc_id, d.text AS utterance, l.quality AS labels
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

ORACLE["roundtrip_jsonl"] = ORACLE["stratified_split"].replace(
    "SELECT doc_id, labels,\n       CASE", "SELECT c.doc_id, d.text AS utterance, c.labels,\n       CASE") \
    .replace("FROM c", "FROM c JOIN documents d ON d.doc_id = c.doc_id")

# second-corpus construction: k = all turns, fixed name 'Speaker'
_PROMPT_WHOLE = _PROMPT.replace(_FIRST.format(x='s."character"'), "'Speaker'")
ORACLE["nli_pairs_whole"] = with_ctes(["v_characters", "sizes", "lens", "turn_emo", "trait_long", "descriptions"], f""",
sample_all AS (
  SELECT c.scene_id, c."character", l.flow_len, s.n_turns AS k
  FROM v_characters c JOIN sizes s ON s.scene_id = c.scene_id CROSS JOIN lens l),
texts AS (
  SELECT s.scene_id, s."character", s.flow_len, 'Speaker' AS c_name,
         {_ORIGIN} AS origin_sent, {_ONLY} AS only_speaker, {_PROMPT_WHOLE} AS affective_prompt
  FROM sample_all s),
j AS (
  SELECT x.*, tl.trait, CASE WHEN tl.flag THEN 1 ELSE 0 END AS label,
         x.origin_sent || x.affective_prompt AS sp,
         x.c_name || ' ' || dp.text AS pos_d, x.c_name || ' ' || dn.text AS neg_d
  FROM texts x
  JOIN trait_long tl ON tl.scene_id = x.scene_id AND tl."character" = x."character"
  JOIN descriptions dp ON dp.trait = tl.trait AND dp.polarity = 'pos'
  JOIN descriptions dn ON dn.trait = tl.trait AND dn.polarity = 'neg')
SELECT scene_id, "character", trait, flow_len, label, label AS nli_label,
       origin_sent, origin_sent AS sent, only_speaker, affective_prompt, sp AS sent_and_prompt, sp AS affective_dialog,
       pos_d AS pos_personality_description, neg_d AS neg_personality_description,
       pos_d AS personality_description, sp AS sentence1, pos_d AS sentence2,
       sp || ' ; ' || pos_d || '; Is it correct? <mask>.' AS model_input
FROM j""")

_ANN_NAMES = ", ".join(f"('{n}')" for n, _ in K.ANNOTATION_CODES)
ORACLE["aligned_distribution"] = with_ctes(["v_annotations", "trait_long"], ",\n" + _align_sql("emory") + f""",
emory_sp AS (
  SELECT e.scene_id, e.pos, e.emotion, t.speaker
  FROM emory e JOIN v_turns t ON t.scene_id = e.scene_id AND t.pos = e.pos),
own AS (
  SELECT s.trait, s.flag, e.emotion, count(*) AS n
  FROM trait_long s
  JOIN emory_sp e ON e.scene_id = s.scene_id
   AND split_part(e.speaker, ' ', 1) = split_part(s."character", ' ', 1)
  WHERE s.flag IS NOT NULL AND e.emotion IS NOT NULL
    AND e.pos < (SELECT max(pos) FROM v_turns x WHERE x.scene_id = e.scene_id)
  GROUP BY ALL),
nm AS (SELECT * FROM (VALUES ('A', 'AGR'), ('C', 'CON'), ('E', 'EXT'), ('O', 'OPN'), ('N', 'NEU')) v(trait, nm)),
grid AS (
  SELECT nm.trait, f.flag, e.emotion, nm.nm
  FROM nm, (VALUES (true), (false)) f(flag), (VALUES {_ANN_NAMES}) e(emotion))
SELECT g.trait, CAST(g.flag AS INTEGER) AS label,
       CASE WHEN g.flag THEN g.nm ELSE 'non-' || g.nm END AS personality,
       g.emotion, CAST(coalesce(o.n, 0) AS BIGINT) AS n,
       {R6("coalesce(o.n, 0) / nullif(sum(coalesce(o.n, 0)) OVER (PARTITION BY g.trait, g.flag), 0)")} AS share
FROM grid g LEFT JOIN own o ON o.trait = g.trait AND o.flag = g.flag AND o.emotion = g.emotion""")

ORACLE["emotion_transition_seven"] = with_ctes(["tagged", "trait_long"], """,
pairs AS (
  SELECT a.scene_id, a.emotion AS e_from, b.emotion AS e_to, b.speaker AS spk_to, a.speaker AS spk_from
  FROM tagged a JOIN tagged b ON b.scene_id = a.scene_id AND b.pos = a.pos + 1),
hits AS (
  SELECT s.trait, p.e_from, p.e_to, count(*) AS n
  FROM trait_long s JOIN pairs p ON p.scene_id = s.scene_id
  WHERE s.flag
    AND split_part(p.spk_from, ' ', 1) <> split_part(s."character", ' ', 1)
    AND split_part(p.spk_to, ' ', 1) = split_part(s."character", ' ', 1)
  GROUP BY ALL),
emos AS (SELECT * FROM (VALUES ('neutral'), ('joy'), ('surprise'), ('anger'), ('sadness'), ('fear'), ('disgust')) e(e)),
grid AS (
  SELECT t.trait, f.e AS e_from, g.e AS e_to
  FROM (VALUES ('A'), ('C'), ('E'), ('O'), ('N')) t(trait), emos f, emos g)
SELECT g.trait, g.e_from, g.e_to, CAST(coalesce(h.n, 0) AS BIGINT) AS n,
       (round(coalesce(h.n, 0) / nullif(sum(coalesce(h.n, 0)) OVER (PARTITION BY g.trait, g.e_from), 0) * 1e6) / 1e6 + 0.0) AS ratio
FROM grid g LEFT JOIN hits h USING (trait, e_from, e_to)""")


# --- operators of the inventory that the queries above do not reach ----------
ORACLE["lexicon_scan"] = f"""
WITH w AS (SELECT unnest({_toks('text', '')}) AS word FROM documents),
c AS (SELECT word, count(*) AS n, length(word) AS size FROM w GROUP BY word)
SELECT word, """ + ", ".join(f"{R6(f'((n * {k} + size) % 20011) / 10000.0 * 1000')} AS {c}"
                             for k, c in ((7, "v"), (11, "a"), (13, "d"))) + " FROM c"

ORACLE["literal_decode"] = with_ctes(["v_characters"], """
SELECT c.scene_id, c."character", CAST(t.pos AS INTEGER) AS pos,
       CAST(split_part(t.speaker, ' ', 1) = split_part(c."character", ' ', 1) AS INTEGER) AS is_speaker
FROM v_characters c JOIN v_turns t ON t.scene_id = c.scene_id""")

ORACLE["label_dump"] = with_ctes(["tagged"], """
SELECT CAST(pos AS INTEGER) AS idx, CAST(emotion_id AS DOUBLE) AS label, count(*) AS n FROM tagged GROUP BY ALL""")

ORACLE["result_append"] = with_ctes(["v_turns"], """
SELECT CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS run, speaker, count(*) AS n FROM v_turns GROUP BY ALL""")

ORACLE["result_commit"] = ORACLE["result_append"]

ORACLE["main_roles"] = with_ctes(["v_characters"], """
SELECT * FROM v_characters WHERE "character" IN ('Una Smith', 'Abe Jones')""")

_PAIR_BODY = ORACLE["nli_pairs"]
ORACLE["model_inputs"] = (_PAIR_BODY[:_PAIR_BODY.rindex("SELECT scene_id")] + """
SELECT label, sp AS text_a, pos_d AS pos_personality_description, neg_d AS neg_personality_description,
       CASE WHEN label = 1 THEN 'yes' ELSE 'no' END AS answer
FROM j""")
ORACLE["question_pairs"] = (_PAIR_BODY[:_PAIR_BODY.rindex("SELECT scene_id")] + """
SELECT scene_id, "character", trait, flow_len, origin_sent AS sent,
       sp || ' Question: ' || pos_d || '? Is it correct? <mask>.' AS model_input
FROM j""")

_CODES = ", ".join(f"('{n}', {c})" for n, c in K.PATTERN_CODES)
ORACLE["pattern_codes"] = with_ctes(["tagged"], f"""
SELECT g.speaker, p.code, count(*) AS n
FROM tagged g JOIN (VALUES {_CODES}) p(name, code) ON p.name = g.emotion GROUP BY ALL""")

ORACLE["speaker_text_first_word"] = with_ctes(["v_characters"], """
SELECT c.scene_id, c."character",
       coalesce((SELECT string_agg(' ' || t.text, '' ORDER BY t.pos) FROM v_turns t
                 WHERE t.scene_id = c.scene_id
                   AND split_part(t.speaker, ' ', 1) = split_part(c."character", ' ', 1)), '') AS utterance
FROM v_characters c""")

ORACLE["trait_value_counts_ordered"] = ORACLE["trait_value_counts"] + " ORDER BY trait, flag"

_SCORES7 = ", ".join(
    f"list_sum(list_transform(range({k}, len(embedding), 7), "
    "lambda i: CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1e6) AS BIGINT)))" for k in range(7))
_NAMES7 = ", ".join(f"'{n}'" for _, n in K.TAG_EMOTIONS)
ORACLE["decision_rule"] = f"""
WITH s AS (SELECT vec_id, [{_SCORES7}] AS s FROM embeddings)
SELECT vec_id, CASE WHEN list_max(s) > 0 THEN [{_NAMES7}][list_position(s, list_max(s))] ELSE 'neutral' END AS emotion FROM s"""

# --- rows known by their place in files --------------------------------------
ORACLE["attach_by_position"] = with_ctes(["v_traits"], """
SELECT scene_id, "character", cAGR, cEXT, cNEU FROM v_traits""")
ORACLE["label_file_regroup"] = ORACLE["emotion_regroup"]
ORACLE["roundtrip_csv"] = ORACLE["roundtrip_tsv"]
ORACLE["lexicon_files"] = f"""
WITH w AS (SELECT unnest({_toks('text', '')}) AS word FROM documents),
c AS (SELECT word, count(*) AS n, CASE WHEN length(word) % 3 = 0 THEN 3 WHEN length(word) % 2 = 0 THEN 2 ELSE 1 END AS k
      FROM w GROUP BY word)
SELECT word, """ + ", ".join(f"{R6(f'((n * {m}) % 2003 + 10000 * k) / 10000.0 * 1000')} AS {c}"
                             for m, c in ((7, "v"), (11, "a"), (13, "d"))) + " FROM c"
ORACLE["batch_metrics"] = with_ctes(["mc"], f""",
r AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS b, label, pred FROM mc),
t AS (SELECT b, label AS k, count(*) AS t FROM r GROUP BY ALL),
p AS (SELECT b, pred AS k, count(*) AS p FROM r GROUP BY ALL),
tt AS (SELECT b, sum(t * t) AS tt FROM t GROUP BY b),
pp AS (SELECT b, sum(p * p) AS pp FROM p GROUP BY b),
pt AS (SELECT t.b, sum(t.t * p.p) AS pt FROM t JOIN p ON p.b = t.b AND p.k = t.k GROUP BY t.b),
s AS (SELECT b, count(*) AS n, count(*) FILTER (label = pred) AS c FROM r GROUP BY b),
m AS (SELECT s.n, CAST(s.c AS DOUBLE) / s.n AS acc, coalesce((CAST(s.c AS DOUBLE) * s.n - coalesce(pt, 0)) / nullif(sqrt(
        (CAST(s.n AS DOUBLE) * s.n - pp) * (CAST(s.n AS DOUBLE) * s.n - tt)), 0), 0.0) AS mcc
      FROM s JOIN tt ON tt.b = s.b JOIN pp ON pp.b = s.b LEFT JOIN pt ON pt.b = s.b)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS n, {R6("sum(acc)")} AS accuracy_sum, {R6("sum(mcc)")} AS mcc_sum FROM m""")
