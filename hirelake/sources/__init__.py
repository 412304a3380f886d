"""hirelake.sources"""
