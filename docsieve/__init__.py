"""docsieve: document-trust analytics expressed as Spark DataFrame plans."""
