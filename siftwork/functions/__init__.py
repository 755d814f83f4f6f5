"""siftwork.functions"""
