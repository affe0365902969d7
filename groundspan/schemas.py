"""Declared schemas. Nothing in the library infers a schema from data."""

SEGMENT = "struct<id:int,start:double,end:double,text:string>"

TRANSCRIPT = (
    "episode_id string, episode_title string, source_file string, "
    "source_sha256 string, duration double, asr_model string, "
    "asr_provider string, language string, "
    f"segments array<{SEGMENT}>"
)

CHUNK = (
    "chunk_id string, episode_id string, episode_title string, "
    "start double, end double, text string, source_file string, "
    "segment_ids array<int>"
)

MANIFEST = (
    "version int, episode_id string, sha256 string, asr_fingerprint string, "
    "title string, source_file string, duration double, "
    "num_segments int, num_chunks int"
)

CASE = (
    "id string, category string, input string, turns array<string>, "
    "expected struct<episode:string,episodes:array<string>,"
    "must_retrieve:array<string>,key_points:array<string>,"
    "refusal:boolean,clarify_ok:boolean>, "
    "must_cite boolean, forbidden_claims array<string>"
)

JUDGE_DIMENSIONS = (
    "faithfulness",
    "completeness",
    "citation_correctness",
    "refusal_correctness",
    "clarity",
)
