"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import WORD, table

# Fixed values of the contract: kind, pattern, group that is measured, its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What the models judge: unbroken runs that could be keys. A digit and a letter must be among them.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LEAST = 20
#: About so many rows train the model of identifiers (chosen by the hash of id and text, at most four times as many where rows repeat; texts are read whole), and random strings generated for the other model.
TRAIN_ROWS = 2000
TRAIN_STRINGS = 4000
#: Mean log-likelihood ratio per character pair (nats) from which a candidate is a secret.
THRESHOLD = 0.75
_CODES = 128
# Ordinary identifiers as programs write them, the labelled sample beside the words of the texts.
IDENTIFIERS = (
    "abs_value access_token_name account_balance add_listener allow_origin apply_filters array_length async_iterator attribute_name average_latency background_color base_directory batch_size buffer_length build_number cache_control "
    "calculateTotal callback_url canonical_name change_password character_count check_sum child_process class_loader client_identifier column_width compare_strings compute_average config_parser connection_timeout content_encoding "
    "content_type_options context_manager convertToString copy_on_write create_directory createElement current_timestamp customer_address database_connection date_format default_value delete_record dependency_injection description_text "
    "destination_path dictionary_keys display_name document_identifier download_progress element_count email_address enable_logging encode_utf event_handler exception_message execution_context expected_result export_function "
    "extract_features field_separator file_extension filter_predicate first_name font_family foreign_key format_string forward_reference function_argument garbage_collection generate_report getElementById global_variable group_by_clause "
    "handle_request hash_function header_checksum horizontal_alignment identity_provider image_height import_module increment_counter index_of_maximum initial_capacity input_stream insert_statement interface_definition "
    "invoice_number is_authenticated item_description iterator_adapter javascript_runtime join_condition keyboard_shortcut language_code last_modified_date latitude_longitude learning_rate left_outer_join library_version line_separator "
    "linked_list listener_registry load_balancer local_storage location_header logging_level lower_case_letters machine_learning_model main_window manifest_version matrix_multiplication maximum_retries memory_allocation merge_request "
    "message_queue metadata_service method_override minimum_distance module_resolution monotonically_increasing mouse_position network_interface next_sibling normalize_whitespace notification_center number_of_elements object_storage "
    "offset_in_bytes onClickHandler operating_system optional_parameter order_by_expression output_directory package_manager page_number parallel_execution parent_component parse_arguments partition_columns payment_method percentage_complete "
    "performance_counter permission_denied phone_number pixel_density placeholder_text pointer_arithmetic post_processing previous_element primary_key print_function priority_queue private_variable process_identifier product_category "
    "property_descriptor protocol_buffer public_interface query_parameters random_generator read_only_property received_bytes rectangle_area recursive_descent reduce_by_key reference_count regular_expression relative_position remove_duplicates"
).split()


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind rank, end, kind) of the pattern's matches that pass, in code points.

    Matches and the gaps between them come from two native functions; positions are their running lengths.
    """
    rank = {k: i for i, (k, *_) in enumerate(BASE)}.get(kind, len(BASE))
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(text, p, F.lit(0))
    judged = hits if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("len"), F.transform(judged, lambda h: F.length(h)).alias("key"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,r:int,e:int,k:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        one = F.array(F.struct(start.alias("s"), F.lit(rank).alias("r"), end.alias("e"), F.lit(kind).alias("k")))
        return F.struct(end.alias("at"), F.when(x["key"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<s:int,r:int,e:int,k:string>>")
    return F.when(F.regexp_like(text, p), found).otherwise(none)


def _pairs(words: Column) -> Column:
    """Index of each pair of neighbouring characters of ``words`` in a 128 x 128 table."""
    return F.transform(F.sequence(F.lit(1), F.length(words) - 1), lambda i: F.ascii(F.substring(words, i, F.lit(1))) * _CODES + F.ascii(F.substring(words, i + 1, F.lit(1))))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, strings: int = TRAIN_STRINGS) -> DataFrame:
    """Log-likelihood ratio of each character pair (random over ordinary), as one row with an array of 128 x 128 numbers.

    Labelled samples: random strings are generated (base 64 and hex of digests of 0, 1, ...), ordinary
    identifiers are the words without digits of about ``rows`` documents, chosen by hash where they lie, and
    IDENTIFIERS. Add-one smoothing over the characters that candidates can have.
    """
    spark = docs.sparkSession
    digests = spark.range(strings).select(F.sha2(F.concat(F.lit("s"), F.col("id")), 512).alias("h"))
    one = digests.select(F.explode(F.array(F.regexp_replace(F.base64(F.unhex("h")), "=", ""), F.substring("h", 1, 48))).alias("w"), F.lit(1).alias("y"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) * F.lit(docs.count())
    picked = docs.where(F.col("text").isNotNull() & (share < rows * 1_000_000)).orderBy(F.xxhash64("doc_id", "text"), "text").select("text").limit(4 * rows)  # equal rows are alike, so the choice is the same whenever it is made
    plain = picked.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_-])[A-Za-z][A-Za-z_-]+(?![A-Za-z0-9+/_-])"), F.lit(0))).alias("w"), F.lit(0).alias("y"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in IDENTIFIERS])).alias("w")).select(F.explode(F.array_repeat("w", 20)).alias("w"), F.lit(0).alias("y"))
    counts = one.unionByName(plain).unionByName(names).select("y", F.explode(_pairs(F.col("w"))).alias("b")).groupBy("b").agg(F.count_if(F.col("y") == 1).alias("r"), F.count_if(F.col("y") == 0).alias("o"))
    alphabet = 65.0  # letters, digits, and three of + / _ -
    first = F.expr(f"cast(b div {_CODES} as int)")
    by = counts.groupBy(first.alias("a")).agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"), F.collect_list(F.struct("b", "r", "o")).alias("cells"))  # at most 128 cells
    score = lambda r, o, ra, oa: F.ln((r + 1) / (ra + alphabet)) - F.ln((o + 1) / (oa + alphabet))
    cells = by.select(F.explode("cells").alias("c"), "ra", "oa").select(F.col("c.b").alias("b"), score(F.col("c.r"), F.col("c.o"), F.col("ra"), F.col("oa")).alias("v"))
    return cells.agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("cells"))  # at most 128 x 128


def _table(docs: DataFrame, rows: int, strings: int) -> Column:
    """The trained table as a literal array: 16384 numbers whatever the input's size."""
    cells = train(docs, rows, strings).first()["cells"] or {}
    return F.from_json(F.lit("[" + ",".join(f"{cells.get(i, 0.0):.6f}" for i in range(_CODES * _CODES)) + "]"), "array<double>")


def random_score(word: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of the word's character pairs: random strings score above 0, ordinary identifiers below."""
    return F.aggregate(_pairs(word), F.lit(0.0), lambda acc, b: acc + F.element_at(model, b + 1)) / F.greatest(F.length(word) - 1, F.lit(1))


def scan(docs: DataFrame, rows: int = TRAIN_ROWS, strings: int = TRAIN_STRINGS, threshold: float = THRESHOLD) -> DataFrame:
    """All spans of every text: ``base`` (the fixed patterns) and ``random`` (what the models add, not overlapping a base span).

    Positions are code points, ends exclusive; both arrays are ordered by start, then kind.
    Null text counts as empty and has no span. Repeated rows are scanned each, and spans that start together are in order of their kind. A very
    long text is one row of native expressions, whole. Extra columns are ignored; an empty table gives an
    empty result (the models then rest on the fixed samples alone).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    model = _table(docs, rows, strings)
    found = docs.select("doc_id", text.alias("_t"), *[_spans(text, *b).alias(f"_{b[0]}") for b in BASE], _spans(text, "random", CANDIDATE, 0, LEAST).alias("_c"))
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    inside = lambda c: F.exists(F.col("base"), lambda b: (c["s"] < b["e"]) & (b["s"] < c["e"]))
    word = lambda c: F.substring(F.col("_t"), c["s"] + 1, c["e"] - c["s"])
    secret = lambda c: F.regexp_like(word(c), F.lit("[0-9]")) & F.regexp_like(word(c), F.lit("[A-Za-z]")) & ~inside(c) & (random_score(word(c), model) >= threshold)
    none = F.array().cast("array<struct<s:int,r:int,e:int,k:string>>")
    out = found.select("doc_id", "_t", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k, *_ in BASE], base.alias("base"), "_c")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.when(F.size("_c") > 0, F.filter("_c", secret)).otherwise(none).alias("random"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def op10_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.array_sort(F.concat("base", "random"))).alias("spans"))
