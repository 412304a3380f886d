"""hirelake.streaming"""
