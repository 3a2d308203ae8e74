"""parcelflow: marketplace-listing analytics on PySpark DataFrames."""
