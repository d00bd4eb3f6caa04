"""Text governance and de-identification on Spark: spans, entities, decisions, mask plans and their validation."""
