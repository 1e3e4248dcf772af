"""Schemas of the engine's tables, as Spark's DDL; nothing is inferred. Names and types are fixed values of the data model."""

MOVIES = """
    id BIGINT NOT NULL, tmdb_id BIGINT NOT NULL, title_ko STRING, title_en STRING, year INT, country STRING,
    genres ARRAY<STRING>, is_animation BOOLEAN, plot_ko STRING, poster_url STRING, kmdb_id STRING, plot_kmdb STRING,
    keywords_ko ARRAY<STRING>
"""
_TAGS = """
    setting: STRING, time_of_day: STRING, weather: STRING, people: STRUCT<count: INT, actions: ARRAY<STRING>>,
    objects: ARRAY<STRING>, colors: ARRAY<STRING>, text_in_frame: STRING
"""
CAPTION = f"STRUCT<caption_ko: STRING, caption_en: STRING, {_TAGS}>"
SCENES = f"""
    id STRING NOT NULL, movie_id BIGINT NOT NULL, source STRING, phash STRING, caption_ko STRING, caption_en STRING,
    tags STRUCT<{_TAGS}>, model_version STRING, created_at TIMESTAMP
"""
REWRITTEN = "STRUCT<scene_ko: STRING, keywords_ko: ARRAY<STRING>, soft_filters: MAP<STRING, STRING>>"
SESSIONS = f"""
    id STRING NOT NULL, created_at TIMESTAMP, query_text STRING, image_key STRING, rewritten {REWRITTEN},
    hard_filters MAP<STRING, STRING>, clarify_turns INT, result_movie_ids ARRAY<BIGINT>, confidence DOUBLE,
    latency_ms INT, cost_usd DECIMAL(10, 6), trace_run_id STRING
"""
FEEDBACK = "id BIGINT NOT NULL, session_id STRING, movie_id BIGINT, is_correct BOOLEAN, created_at TIMESTAMP"
LEDGER = "step STRING NOT NULL, item_id STRING NOT NULL, model_version STRING NOT NULL, done_at TIMESTAMP"

# Fixed values of the model: where pictures come from, and the times of day that a caption may name.
SOURCES = ("backdrop", "still", "trailer")
TIMES_OF_DAY = ("day", "night", "dawn", "dusk", "unknown")
