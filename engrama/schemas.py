"""Table schemas of the memory-graph model, as DDL."""

MEM = "id STRING, blocks ARRAY<STRING>, text STRING, source STRING, revelant ARRAY<STRING>, core_files ARRAY<STRUCT<name: STRING, path: STRING, content: STRING>>, deprecated_by STRING, time TIMESTAMP"
BLOCK_VEC = "id STRING, block_no INT, vec ARRAY<FLOAT>"
EDGE = "source STRING, target STRING, type STRING, weight DOUBLE, evidence STRING"
PRECOG = "record_id STRING, query STRING, keywords ARRAY<STRING>, top_k INT, results ARRAY<STRUCT<id: STRING, accuracy: STRING, summary: STRING>>, description STRING"
DERIVED = "derived_from STRING, source_blocks ARRAY<INT>, blocks ARRAY<STRING>, reason STRING, kind STRING, created_at TIMESTAMP, status STRING, validation STRING"
EMBEDDING_CACHE = "hash LONG, text STRING, vec ARRAY<FLOAT>"
EDGE_TYPES = ("reference", "entity", "semantic", "temporal", "usage")
