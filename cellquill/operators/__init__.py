"""Operators over records (barcode, umi, ec, count, flags, pad): plain functions from DataFrames to DataFrames."""
