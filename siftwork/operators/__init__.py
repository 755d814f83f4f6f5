"""siftwork.operators"""
