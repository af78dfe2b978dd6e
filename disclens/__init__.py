"""PySpark analytics over purchase-history disclosures."""
