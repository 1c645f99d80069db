"""Folium: OCR-text quality, denoising evaluation and agreement operators on Spark DataFrames."""
