"""Declared schemas of the archive's tables; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_T = {"s": StringType(), "l": LongType(), "i": IntegerType(), "d": DoubleType(), "b": BooleanType(), "t": TimestampType(), "as": ArrayType(StringType()), "al": ArrayType(LongType())}


def _schema(spec: str) -> StructType:
    return StructType([StructField(n, _T[t], True) for n, t in (x.split(":") for x in spec.split())])


DOCUMENTS = _schema(
    "id:l bates_number:s source_url:s source_page:s data_set:s category:s filename:s local_path:s file_hash:s file_size:l content_type:s document_type:s title:s description:s document_date:t "
    "download_timestamp:t last_modified:s processing_status:s ocr_confidence:d ocr_completed_at:t page_count:i has_text:b needs_ocr:b contains_graphic_content:b content_warning:s created_at:t updated_at:t"
)
DOCUMENT_TEXTS = _schema("id:l document_id:l full_text:s pages_text:as ocr_engine:s ocr_language:s average_confidence:d word_count:i created_at:t")
ENTITIES = _schema(
    "id:l canonical_name:s entity_type:s first_name:s last_name:s aliases:as description:s is_public_figure:b wikipedia_url:s disambiguation_notes:s confidence:d needs_review:b mention_count:l created_at:t updated_at:t"
)
MENTIONS = _schema(
    "id:l document_id:l entity_id:l name_as_appears:s role:s role_confidence:d role_evidence:s page_number:i position_start:i position_end:i context_snippet:s extraction_confidence:d disambiguation_confidence:d needs_review:b created_at:t"
)
RELATIONSHIPS = _schema("id:l entity1_id:l entity2_id:l relationship_type:s description:s start_date:t end_date:t date_approximate:b evidence_document_ids:al evidence_description:s confidence:d needs_review:b created_at:t updated_at:t")
VERIFIED_CLAIMS = _schema("id:l claim_text:s claim_summary:s status:s supporting_document_ids:al contradicting_document_ids:al evidence_summary:s source:s source_url:s created_at:t updated_at:t")
PROCESSING_LOGS = _schema("id:l document_id:l action:s status:s message:s error_details:s duration_ms:i created_at:t")
COOCCURRENCE = _schema("entity_id:l other_entity_id:l shared_docs:l")
OCR_RESULT = _schema("document_id:l filename:s status:s full_text:s confidence:d page_count:i error:s seconds:d updated_at:t")
DOWNLOAD_METADATA = _schema("url:s filename:s local_path:s file_hash:s file_size:l content_type:s source_page:s data_set:s category:s download_timestamp:s last_modified:s title:s _corrupt_record:s")
EVALUATION_MANIFEST = _schema("document_id:l page_number:i confidence:d confidence_band:s ground_truth_path:s")
INVENTORY = _schema("key:s size:l content_type:s")
IMAGE = _schema("filename:s doc_id:l page:i width:i height:i size:l")
IMAGE_MANIFEST = StructType([StructField("total_images", LongType()), StructField("images", ArrayType(IMAGE))])
