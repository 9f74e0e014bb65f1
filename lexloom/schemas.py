"""Row types of the engine's tables."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _I, _D = StringType(), IntegerType(), DoubleType()

DOCUMENT = _struct(doc_id=_S, text=_S, source=_S, law_name=_S, article_number=_S, chapter=_S, section=_S,
                   num_articles=_I, num_chapters=_I, extra=MapType(_S, _S))
CHUNK = _struct(doc_id=_S, chunk_id=_S, text=_S, chunk_index=_I, chunk_size=_I, chunking_method=_S, article_number=_S, chapter=_S,
                hierarchy_level=_S, hierarchy_path=_S, parent_part=_S, parent_chapter=_S, parent_section=_S, sub_chunk_index=_I)
EMBEDDED_CHUNK = StructType([*CHUNK.fields, StructField("embedding", ArrayType(FloatType()))])
RETRIEVAL = _struct(query_id=LongType(), rank=_I, chunk_id=_S, score=_D)
CLAIM = _struct(claim=_S, is_supported=BooleanType(), confidence=_D, keyword_score=_D, semantic_score=_D)
RESPONSE = _struct(query=_S, answer=_S, sources=ArrayType(_struct(chunk_id=_S, score=_D)), confidence=_D, hallucination_flags=ArrayType(_S),
                   retrieval_time=_D, generation_time=_D)
TEST_QUERY = _struct(id=_S, query=_S, category=_S, difficulty=_S, expected_law=_S, expected_articles=ArrayType(_S))
GROUND_TRUTH = _struct(query_id=_S, expected_answer=_S, relevant_articles=ArrayType(_S), source_law=_S)
EXPERIMENT = _struct(name=_S, variable=_S, value=_S, metric=_S, score=_D)
