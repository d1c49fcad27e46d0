"""paperfold: document-extraction data work as Spark DataFrame operators."""
