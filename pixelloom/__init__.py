"""pixelloom: image-text-mask corpus preparation and evaluation on Spark DataFrames."""
