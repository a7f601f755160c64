"""formlake: form-document analytics on Spark DataFrames."""
