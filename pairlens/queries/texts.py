"""Queries over texts: counting, truncation, rendering, parsing, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions import answers, chat, text
from pairlens.operators.annotate import cache_key
from pairlens.operators.dedup import unique_texts
from pairlens.prompts import template
from pairlens.queries.registry import first_words, human, last_words, pair_sql, query, responses_sql, strip_sql, words
from pairlens.functions.text import LEFT_MARK, RIGHT_MARK
from pairlens.sources import derived
from pairlens.sources.derived import table


@query(f"SELECT doc_id, {words('text')} AS n_words FROM documents")
def document_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query("SELECT row_id, length_delta FROM rows", ("rows",))
def response_length_delta(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir)
    return prefs.select("row_id", text.length_delta(F.col("response_A"), F.col("response_B")).alias("length_delta"))


@query(f"SELECT doc_id, {first_words('text', 128)} AS cut FROM documents")
def texts_cut_to_first_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.truncate_col(F.col("text"), max_words=128).alias("cut"))


@query(f"SELECT doc_id, {last_words('text', 128)} AS cut FROM documents")
def texts_cut_to_last_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.truncate_col(F.col("text"), max_words=128, left=True).alias("cut"))


@query(
    f"""SELECT doc_id, CASE WHEN NOT ends_with(text, '{RIGHT_MARK}') AND length(text) > 500
        THEN substr(text, 1, 500) || '{RIGHT_MARK}' ELSE text END AS head,
        CASE WHEN NOT starts_with(text, '{LEFT_MARK}') AND length(text) > 500
        THEN '{LEFT_MARK}' || substr(text, length(text) - 499) ELSE text END AS tail FROM documents"""
)
def texts_cut_to_characters(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.truncate_col(c, max_chars=500).alias("head"),
        text.truncate_col(c, max_chars=500, left=True).alias("tail"),
    )


@query(
    f"""SELECT doc_id, count(*) AS n_lines, count(CASE WHEN {strip_sql('line')} <> '' THEN 1 END) AS n_valid
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""
)
def valid_lines_per_document(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_valid_text(F.col("line"))).alias("n_valid")
    )


@query(
    f"""SELECT row_id, md5(({human('prompt')}) || chr(10) || chr(10) || 'Assistant: ' || response_A) AS text_a,
        md5(({human('prompt')}) || chr(10) || chr(10) || 'Assistant: ' || response_B) AS text_b FROM prefs""",
    ("prefs",),
)
def prompt_response_texts(spark, sf_dir):
    prompt = F.col("prompt")
    return derived.preferences(spark, sf_dir).select(
        "row_id",
        F.md5(text.prompt_response_text(prompt, F.col("response_A"))).alias("text_a"),
        F.md5(text.prompt_response_text(prompt, F.col("response_B"))).alias("text_b"),
    )


@query(f"SELECT row_id, md5({pair_sql()}) AS with_context, md5({responses_sql()}) AS without FROM prefs", ("prefs",))
def rendered_pairs(spark, sf_dir):
    c = F.col("prompt"), F.col("response_A"), F.col("response_B")
    return derived.preferences(spark, sf_dir).select(
        "row_id",
        F.md5(text.pairwise_text(*c)).alias("with_context"),
        F.md5(text.pairwise_text(*c, include_prompt=False)).alias("without"),
    )


@query(
    f"""SELECT row_id, md5(CASE WHEN length_delta < 0 THEN regexp_replace(pair,
          '(RESPONSE A: "Assistant: )(.*?)("\n\nRESPONSE B: "Assistant: )(.*?)(")', '\\1\\4\\3\\2\\5', 'gs')
        ELSE pair END) AS pair FROM (SELECT row_id, length_delta, {pair_sql()} AS pair FROM rows)""",
    ("rows",),
)
def pairs_swapped_if_shorter(spark, sf_dir):
    a, b = F.col("response_A"), F.col("response_B")
    return derived.preferences(spark, sf_dir).select(
        "row_id", F.md5(text.swap_if_negative(text.pairwise_text(F.col("prompt"), a, b), text.length_delta(a, b))).alias("pair")
    )


ANSWER = """CASE WHEN quality = 1 AND toxic = 1 THEN ' Tie' || chr(10) WHEN quality = 1 THEN 'A '
            WHEN toxic = 1 THEN 'b' ELSE 'neither' END"""


@query(
    f"""SELECT doc_id, CAST(CASE lower({strip_sql('answer')}) WHEN 'a' THEN 1 WHEN 'b' THEN -1 WHEN 'tie' THEN 0 END AS INTEGER) AS code
        FROM (SELECT doc_id, {ANSWER} AS answer FROM labels)"""
)
def parsed_pair_answers(spark, sf_dir):
    answer = F.expr(ANSWER.replace("chr(10)", "char(10)"))
    return table(spark, sf_dir, "labels").select("doc_id", answers.parse_pairwise(answer).alias("code"))


ANSWER_LIST = """CASE WHEN quality = 1 AND toxic = 1 THEN '["A", "B", "Tie"]'
    WHEN quality = 1 THEN 'Here: [a, "TIE".' || chr(10) || 'b, B]' WHEN toxic = 1 THEN '[A, x, B]' ELSE '[A, B]' END"""


@query(
    f"""SELECT doc_id, codes[1] AS first, codes[2] AS second, codes[3] AS third FROM (
          SELECT doc_id, CASE WHEN len(codes) >= 3 AND len(list_filter(codes, lambda c: c IS NULL)) = 0
                 THEN codes END AS codes FROM (
            SELECT doc_id, list_transform(regexp_split_to_array(regexp_extract(answer, '\\[([^\\]]+)\\]', 1), '[,\\n]+'),
              lambda w: CAST(CASE lower(trim(w, ' "''.,' || chr(10))) WHEN 'a' THEN 1 WHEN 'b' THEN -1 WHEN 'tie' THEN 0 END AS INTEGER)) AS codes
            FROM (SELECT doc_id, {ANSWER_LIST} AS answer FROM labels)))"""
)
def parsed_answer_lists(spark, sf_dir):
    answer = F.expr(ANSWER_LIST.replace("chr(10)", "char(10)"))
    codes = table(spark, sf_dir, "labels").select("doc_id", answers.parse_multi_label(answer, 3).alias("c"))
    return codes.select("doc_id", F.col("c")[0].alias("first"), F.col("c")[1].alias("second"), F.col("c")[2].alias("third"))


DESCRIPTION = """CASE WHEN lang = 'en' THEN '- "' || source || '"' WHEN n_chars > 1000 THEN '"- ' || source || '"'
    WHEN n_chars > 500 THEN '" - ' || source || ' "' ELSE '  ' || source || ' ' END"""


@query(
    f"""SELECT doc_id, {strip_sql("trim(c, '\"')")} AS description FROM (
          SELECT doc_id, CASE WHEN starts_with(b, '" -') THEN substr(b, 4) ELSE b END AS c FROM (
            SELECT doc_id, CASE WHEN starts_with(a, '"-') THEN substr(a, 3) ELSE a END AS b FROM (
              SELECT doc_id, CASE WHEN starts_with(s, '- ') THEN substr(s, 3) ELSE s END AS a FROM (
                SELECT doc_id, {strip_sql(DESCRIPTION)} AS s FROM documents))))"""
)
def cleaned_descriptions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", answers.clean_interpretation(F.expr(DESCRIPTION)).alias("description"))


ANNOTATE = template("pairwise-annotate-singleconcept")


@query(
    f"""SELECT row_id, md5(replace(replace('{ANNOTATE}', '{{concept}}', conversation_id), '{{text}}', {pair_sql()})) AS prompt
        FROM prefs""",
    ("prefs",),
)
def rendered_prompts(spark, sf_dir):
    pair = text.pairwise_text(F.col("prompt"), F.col("response_A"), F.col("response_B"))
    return derived.preferences(spark, sf_dir).select(
        "row_id", F.md5(text.render(ANNOTATE, text=pair, concept=F.col("conversation_id"))).alias("prompt")
    )


@query("SELECT doc_id, sha256(concat_ws(chr(1), 'm', 'p', source, text)) AS key FROM documents")
def annotation_cache_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", cache_key("m", "p", F.col("source"), F.col("text")).alias("key"))


_TURNS = """tagged AS (SELECT conv_id, turn, text,
      CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: ' END || text AS line FROM conversations),
    spoken AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM tagged WHERE line IS NOT NULL)"""
_TRANSCRIPTS = "texts AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS text FROM spoken GROUP BY conv_id)"
_REPLIES = """texts AS (SELECT conv_id, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE back > 1), '') AS text,
      max(text) FILTER (WHERE back = 1) AS chosen, arg_min(text, turn) AS rejected FROM spoken GROUP BY conv_id)"""


def _parts_cte(texts: str) -> str:
    """Fragments ending in ``parts``: the rows of ``texts`` with their messages."""
    return f"""{_TURNS}, {texts},
    parts AS (SELECT *, list_filter(list_transform(
        string_split(regexp_replace(text, '(Human:|Assistant:)', chr(1) || '\\1', 'g'), chr(1))[2:],
        lambda p: {{'role': CASE WHEN starts_with(p, 'Human:') THEN 'user' ELSE 'assistant' END,
                   'content': """ + strip_sql("regexp_replace(p, '^(Human|Assistant):', '')") + """}),
        lambda m: m.content <> '') AS messages FROM texts)"""


@query(
    f"""WITH {_parts_cte(_TRANSCRIPTS)} SELECT conv_id, len(messages)::integer AS n_messages,
        array_to_string(list_transform(messages, lambda m: m.role || ':' || m.content), '|') AS content FROM parts"""
)
def transcript_messages(spark, sf_dir):
    parsed = derived.transcripts(spark, sf_dir).withColumn("m", chat.parse_transcript(F.col("text")))
    return parsed.select(
        "conv_id",
        F.size("m").alias("n_messages"),
        F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("content"),
    )


@query(
    f"""WITH {_parts_cte(_REPLIES)} SELECT conv_id, CASE WHEN len(messages) = 0 THEN text
        WHEN messages[len(messages)].role = 'user' THEN messages[len(messages)].content END AS last_user FROM parts"""
)
def transcripts_ending_on_user(spark, sf_dir):
    """Of the transcripts before the last turn; null where they end on the assistant."""
    fixed = derived.replies(spark, sf_dir).withColumn(
        "m", chat.ensure_user_last(chat.parse_transcript(F.col("prompt")), F.col("prompt"), strict=False)
    )
    return fixed.select("conv_id", F.try_element_at("m", F.lit(-1))["content"].alias("last_user"))


@query(
    "SELECT row_id, md5(CASE WHEN label = 1 THEN response_A ELSE response_B END) AS chosen, "
    "md5(CASE WHEN label = 1 THEN response_B ELSE response_A END) AS rejected FROM prefs",
    ("prefs",),
)
def chosen_and_rejected(spark, sf_dir):
    sides = chat.chosen_rejected(derived.preferences(spark, sf_dir))
    return sides.select("row_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


def _rendered_sql(side: str) -> str:
    convo = f"""list_append(CASE WHEN len(messages) = 0 THEN [{{'role': 'user', 'content': text}}] ELSE messages END,
        {{'role': 'assistant', 'content': {strip_sql(f"coalesce({side}, '')")}}})"""
    return f"array_to_string(list_transform({convo}, lambda m: '<|' || m.role || '|>' || chr(10) || m.content), chr(10))"


@query(
    f"""WITH {_parts_cte(_REPLIES)}, told AS (
        SELECT conv_id, len(messages) = 0 OR messages[len(messages)].role = 'user' AS accepted, greatest(len(messages), 1) + 1 AS n,
          {words(_rendered_sql('chosen'))} AS a, {words(_rendered_sql('rejected'))} AS b FROM parts)
        SELECT conv_id, accepted, CASE WHEN accepted THEN n::integer END AS n_messages,
          CASE WHEN accepted THEN greatest(a, b)::integer END AS length FROM told"""
)
def reward_conversation_lengths(spark, sf_dir):
    """Conversations whose prompt ends on the assistant are kept as rejects, without a length."""
    built = chat.reward_conversations(derived.replies(spark, sf_dir), strict=False)
    accepted = F.col("chosen").isNotNull()
    return built.select(
        "conv_id", accepted.alias("accepted"), F.when(accepted, F.size("chosen")).alias("n_messages"), "length"
    )


@query(
    """SELECT row_id, md5('Represent the answer' || chr(10) || 'User: ' || prompt || chr(10) || 'Assistant: ' || response_A)
       AS instructed FROM prefs""",
    ("prefs",),
)
def instructed_texts(spark, sf_dir):
    shaped = text.instructed_text(F.col("prompt"), F.col("response_A"), "Represent the answer")
    return derived.preferences(spark, sf_dir).select("row_id", F.md5(shaped).alias("instructed"))


@query(
    f"""SELECT doc_id, replace(CASE WHEN NOT ends_with(text, '{RIGHT_MARK}') AND length(text) > 128
        THEN substr(text, 1, 128) || '{RIGHT_MARK}' ELSE text END, chr(10), ' ') AS preview FROM documents"""
)
def document_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT DISTINCT sha256(t) AS text_key FROM (SELECT response_A AS t FROM prefs UNION ALL SELECT response_B FROM prefs)", ("prefs",))
def unique_response_texts(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir)
    return unique_texts(prefs, F.col("response_A"), F.col("response_B")).select("text_key")
