"""quillspan: evidence-grounded text analytics as Spark DataFrame plans."""
