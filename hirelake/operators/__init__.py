"""hirelake.operators"""
